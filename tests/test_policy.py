import pytest
from hypothesis import given
from hypothesis import strategies as st

from wardstone.errors import Code, GovernanceError
from wardstone.plans.policy import ColumnKey, PolicyIndex, Selector, Subject, dump_policies, glob_match, load_legacy, load_policies, validate
from wardstone.plans.script import classify, join, limit_of, split
from wardstone.sources.metadata import degrade, dump_metadata, load_metadata, resolve_type

YAML = """
policies:
- name: low
  priority: 1
  resources: [{catalog: c, schema: s, table: t, column: [a, b]}]
  dataMaskItems: [{groups: ['*'], udf: mask_text}, {users: [ann], udf: mask_name}]
- name: high
  priority: 5
  resources: [{table: t, column: 'a*'}]
  dataMaskItems: [{groups: [staff], udf: mask_hash, arguments: [md5]}]
- name: rows
  resources: [{table: t}]
  rowFilterItems: [{groups: ['*'], condition: 'x > 0'}]
- name: rows2
  resources: [{table: '*'}]
  rowFilterItems: [{groups: [staff], condition: 'y = 1'}]
"""
A, B = ColumnKey("c", "s", "t", "a"), ColumnKey("c", "s", "t", "b")


def test_priority_then_specificity():
    index = PolicyIndex(load_policies(YAML))
    ann, staff, other = Subject("ann"), Subject("bo", frozenset({"staff"})), Subject("cy")
    assert index.mask(ann, A)[1].udf == "mask_name"
    assert index.mask(staff, A)[1].udf == "mask_hash"
    assert index.mask(staff, B)[1].udf == "mask_text"
    assert index.mask(other, A)[1].udf == "mask_text"
    assert index.mask(other, ColumnKey("c", "s", "u", "a")) is None
    assert index.filters(staff, ("c", "s", "t")) == ["x > 0", "y = 1"]
    assert index.effective(staff, [A, B])[1] == {("c", "s", "t"): "(x > 0) AND (y = 1)"}
    assert Selector(("*",)).specificity(other) == 1


def test_round_trip_and_errors():
    policies = load_policies(YAML)
    assert load_policies(dump_policies(policies)) == policies
    validate(policies, [A, B])
    for bad in ("policies: [{name: a, name: b}]", "policies: [{name: a, resources: [{table: t, column: c}]}]", "policies: [{name: a, resources: [], dataMaskItems: []}]"):
        with pytest.raises(GovernanceError) as e:
            load_policies(bad)
        assert e.value.code is Code.CONFIG_ERROR
    with pytest.raises(GovernanceError, match="no declared column"):
        validate(policies, [ColumnKey("c", "s", "z", "q")])


def test_legacy():
    found = load_legacy("policies: {m: {udf: mask_phone, arguments: [3, 4]}}\ncolumns: {c.s.t.a: m}\nrowFilters: {c.s.t: 'x = 1'}")
    assert [(p.kind, p.priority) for p in found] == [("mask", 0), ("filter", 0)]


@given(st.text("ab*._", max_size=8), st.text("ab._", max_size=8))
def test_glob(pattern, value):
    def slow(p, v):
        if not p:
            return not v
        if p[0] == "*":
            return any(slow(p[1:], v[i:]) for i in range(len(v) + 1))
        return bool(v) and v[0] == p[0] and slow(p[1:], v[1:])

    assert glob_match(pattern, value) == slow(pattern, value)


def test_splitter():
    script = "select ';' ; -- c;\n /* a; /* b; */ ; */ ;select $x$;$x$, \"a;b\", E'\\';' ;;  "
    assert split(script) == ["select ';'", "select $x$;$x$, \"a;b\", E'\\';'"]
    assert join(["a", "b"]) == "a;\n\nb;"
    assert split("-- only\n/* x */") == []


@pytest.mark.parametrize(("sql", "kind"), [("select 1", "SELECT"), ("/* c */ with a as (select 1) select * from a", "SELECT"), ("insert into t (a) select 1", "INSERT_SELECT"), ("INSERT OVERWRITE TABLE t SELECT 1", "INSERT_SELECT"), ("create table if not exists t as select 1", "CTAS")])
def test_kinds(sql, kind):
    assert classify(sql)[0] == kind


@pytest.mark.parametrize("sql", ["update t set a = 1", "delete from t", "drop table t", "set x=1", "explain select 1", "create or replace table t as select 1", "merge into t using u on 1=1 when matched then delete", "insert into t select 1 on conflict do nothing"])
def test_refused(sql):
    with pytest.raises(GovernanceError) as e:
        classify(sql)
    assert e.value.code is Code.UNSUPPORTED_STATEMENT


def test_top():
    assert limit_of("SELECT TOP (5) a FROM t") == "SELECT a FROM t LIMIT 5"
    with pytest.raises(GovernanceError):
        limit_of("SELECT TOP 5 PERCENT a FROM t")


def test_types():
    assert resolve_type("decimal(10,2)", "mysql").simpleString() == "decimal(10,2)"
    assert resolve_type("decimal(10)", "trino").simpleString() == "decimal(10,0)"
    with pytest.raises(GovernanceError):
        resolve_type("decimal(10)", "hive")
    assert degrade("int[]", "postgresql")[1] and not degrade("bigint", "postgresql")[1]
    text = "tables: [{catalog: c, schema: s, name: T, columns: [{name: A, type: 'varchar(5)'}]}]"
    tables = load_metadata(text)
    assert load_metadata(dump_metadata(tables)) == tables
    with pytest.raises(GovernanceError):
        load_metadata("tables: [{name: t, columns: [{name: a, type: int}, {name: A, type: int}]}]")
