import pytest

from wardstone.errors import Code, GovernanceError
from wardstone.functions.masks import MASKS, SQL_BODIES, deploy
from wardstone.operators.catalog import Gateway, Grant, Grants, Signature, resolve, resync
from wardstone.plans.policy import Subject, load_policies
from wardstone.plans.session import Governance, check_condition

ANN = Subject("ann")


@pytest.fixture
def g(spark):
    customer = spark.createDataFrame([(1, "13812345678", "a@x.org", "active"), (2, "13900001111", "b@y.org", "active"), (3, "13711112222", None, "gone")], "id long, phone string, email string, status string")
    orders = spark.createDataFrame([(10, 1, 5.0), (11, 3, 7.0)], "id long, customer_id long, amount double")
    return Governance(spark, {"customer": customer, "orders": orders}, load_policies("""
policies:
- name: phone
  resources: [{table: customer, column: phone}]
  dataMaskItems: [{groups: ['*'], udf: mask_phone, arguments: [3, 4]}]
- name: email
  resources: [{table: customer, column: email, inheritOnCopy: true}]
  dataMaskItems: [{groups: ['*'], udf: mask_email}]
- name: active
  resources: [{table: customer}]
  rowFilterItems: [{groups: ['*'], condition: "status = 'active'"}]
"""))


def test_masks_agree_with_sql(spark):
    own = spark.newSession()
    deploy(own)
    df = own.createDataFrame([(x,) for x in ("", "a", "ab", "1234567", "12345678901", "me@x", "@", "no", None, "123456789012345678")], "v string")
    df.createOrReplaceTempView("t")
    for name, mask in MASKS.items():
        assert [r[0] for r in df.select(mask(df.v)).collect()] == [r[0] for r in own.sql(f"SELECT {name}(v) FROM t").collect()]
    assert set(MASKS) == set(SQL_BODIES)
    assert [r[0] for r in df.select(MASKS["mask_phone"](df.v)).collect()][4] == "123****8901"


def test_filter_and_mask(g):
    rows = g.secure_sql(ANN, "SELECT id, phone, email, status FROM customer").collect()
    assert [(r.id, r.phone) for r in rows] == [(1, "138****5678"), (2, "139****1111")]
    assert rows[0].email == "a***@x.org"


def test_smallest_key_decides(g):
    assert g.plan(ANN, "SELECT concat(phone, email) AS x FROM customer")[0].masked == {"x": "mask_email"}


@pytest.mark.parametrize(("sql", "code"), [
    ("SELECT id IN (SELECT customer_id FROM orders) AS z FROM customer", Code.LINEAGE_UNKNOWN), ("SELECT phone, email AS phone FROM customer", Code.REWRITE_ERROR), ("SELECT nope FROM customer", Code.VALIDATION_ERROR), ("SELEC 1", Code.UNSUPPORTED_STATEMENT),
    ("SELECT * FROM customer WHERE id = ", Code.PARSE_ERROR), ("DROP TABLE customer", Code.UNSUPPORTED_STATEMENT), ("SELECT * FROM parquet.`/tmp/x`", Code.VALIDATION_ERROR),
])
def test_refusals(g, sql, code):
    with pytest.raises(GovernanceError) as e:
        g.plan(ANN, sql)
    assert e.value.code is code and "statement 1" in str(e.value)


@pytest.mark.parametrize("condition", ["upper(a) = 'X'", "a LIKE 'x'", "a NOT IN (1)", "CAST(a AS INT) = 1", "a IN (SELECT 1)", "a BETWEEN 1 AND upper(2)", "CASE WHEN a THEN b END"])
def test_conditions(spark, condition):
    with pytest.raises(GovernanceError):
        check_condition(spark, condition)
    check_condition(spark, "(a + 1) * 2 >= 3 AND NOT b <=> 'x' OR c IS NOT NULL AND d IN (1, 2)")


def test_block(g):
    g.block("ann", "customer")
    g.block("ann", "customer")
    assert g.secure_sql(ANN, "SELECT * FROM customer").count() == 0
    assert g.secure_sql(Subject("bo"), "SELECT * FROM customer").count() == 2
    g.unblock("ann", "customer")
    assert g.secure_sql(ANN, "SELECT * FROM customer").count() == 2


def test_writes_and_inheritance(g, spark):
    spark.sql("DROP TABLE IF EXISTS copied")
    try:
        g.run(ANN, "CREATE TABLE copied AS SELECT id, phone, email FROM customer")
        raw = {r.id: r for r in spark.table("copied").collect()}
        assert raw[1].phone == "138****5678" and raw[1].email == "a@x.org"
        assert g.secure_sql(ANN, "SELECT email FROM copied WHERE id = 1").first()[0] == "a***@x.org"
        g.run(ANN, "INSERT INTO copied (id, phone) SELECT id + 10, phone FROM customer")
        assert g.secure_sql(ANN, "SELECT * FROM copied").count() == 4
        with pytest.raises(GovernanceError) as e:
            g.plan(ANN, "INSERT INTO copied SELECT id, phone, upper(email) FROM customer")
        assert e.value.code is Code.LINEAGE_UNKNOWN
        with pytest.raises(GovernanceError):
            g.plan(ANN, "CREATE TABLE z AS SELECT email FROM customer", registered=False)
    finally:
        spark.sql("DROP TABLE IF EXISTS copied")


def test_gateway(g):
    out = Gateway(g).query(ANN, "SELECT id, phone FROM customer ORDER BY id", 1)
    assert out["rows"] == [[1, "138****5678"]] and out["truncated"] and out["masked"] == ["phone"]
    with pytest.raises(GovernanceError):
        Gateway(g).query(ANN, "SELECT 1; SELECT 2")


def test_pushdown(g, spark):
    spark.range(10).selectExpr("id", "cast(id as string) phone", "'active' status").write.mode("overwrite").parquet("/tmp/wardstone-push")
    own = Governance(spark, {"t": spark.read.parquet("/tmp/wardstone-push")}, load_policies("policies: [{name: f, resources: [{table: t}], rowFilterItems: [{groups: ['*'], condition: 'id > 3'}]}]"))
    plan = own.secure_sql(ANN, "SELECT phone FROM t WHERE status = 'active'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "EqualTo(status,active)" in plan


def test_grants_and_functions(spark):
    grants = Grants()
    for _ in range(2):
        grants.give(Grant("ann", "c.s.t", "SELECT"))
    assert grants.preview("postgresql") == ['GRANT SELECT ON s.t TO "g_ann"']
    assert grants.matrix(spark).count() == 1
    a, b = Signature("f", ("string", "int")), Signature("f", ("varchar", "int"))
    assert resolve([a, b], "f", "varchar", (1,)) == b
    assert resync({a}, {b}) == {"added": set(), "missing": set(), "changed": {b}}


@pytest.fixture
def store(spark):
    """Catalog tables and a second schema, gone afterwards."""
    spark.sql("CREATE DATABASE IF NOT EXISTS db2")
    yield spark
    for t in ("copied", "sink", "db2.copied", "default.cp2", "db2.cp2"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.sql("DROP DATABASE IF EXISTS db2 CASCADE")


@pytest.mark.parametrize("sql", ["FROM customer INSERT INTO sink SELECT id, email", "FROM customer INSERT INTO sink SELECT id, email INSERT INTO sink SELECT id, phone", "WITH c AS (SELECT * FROM customer) INSERT INTO sink SELECT id, email FROM c", "FROM customer INSERT OVERWRITE DIRECTORY '/tmp/wardstone-dir' USING parquet SELECT email", "(FROM customer INSERT INTO sink SELECT id, email)"])
def test_hidden_writes_are_refused_and_write_nothing(g, store, sql):
    store.sql("CREATE TABLE sink (id LONG, email STRING) USING parquet")
    for way in (g.plan, g.secure_sql, g.run):
        with pytest.raises(GovernanceError) as e:
            way(ANN, sql)
        assert e.value.code in (Code.UNSUPPORTED_STATEMENT, Code.PARSE_ERROR)
    store.catalog.refreshTable("sink")
    assert store.table("sink").count() == 0


def test_copies_keep_all_policies(spark, store):
    customer = spark.createDataFrame([(1, "a@x.org")], "id long, email string")
    g = Governance(spark, {"customer": customer}, load_policies("""
policies:
- {name: staff, priority: 5, resources: [{table: customer, column: email, inheritOnCopy: true}], dataMaskItems: [{groups: [staff], udf: mask_text}]}
- {name: all, resources: [{table: customer, column: email}], dataMaskItems: [{groups: ['*'], udf: mask_email}]}
"""))
    staff = Subject("sy", frozenset({"staff"}))
    g.run(ANN, "CREATE TABLE copied AS SELECT id, email FROM customer")
    seen = lambda who, t: g.secure_sql(who, f"SELECT email FROM {t}").first()[0]
    assert (seen(ANN, "copied"), seen(staff, "copied")) == ("a***@x.org", "***") == (seen(ANN, "customer"), seen(staff, "customer"))
    g.run(staff, "INSERT INTO copied (EMAIL, ID) SELECT email, id + 1 FROM customer")
    assert sorted(map(tuple, spark.table("copied").collect())) == [(1, "a@x.org"), (2, "a@x.org")]
    g.run(ANN, "CREATE TABLE db2.copied AS SELECT id, email FROM customer")
    assert spark.table("db2.copied").first().email == "a@x.org" and seen(ANN, "db2.copied") == "a***@x.org"
    g.run(ANN, "INSERT INTO db2.copied SELECT id + 5, email FROM default.copied WHERE id = 1")
    assert spark.table("db2.copied").count() == 2 and spark.table("default.copied").count() == 2
    with pytest.raises(GovernanceError) as e:
        g.plan(ANN, "SELECT email FROM copied")
    assert e.value.code is Code.VALIDATION_ERROR and "several" in str(e.value)
    with pytest.raises(GovernanceError):
        g.run(ANN, "INSERT INTO default.copied (id, nope) SELECT 1, 2")


def test_registration_comes_before_writing(spark, store):
    g = Governance(spark, {"customer": spark.createDataFrame([(1, "a@x.org")], "id long, email string")}, load_policies("""
policies:
- {name: e, resources: [{table: customer, column: email, inheritOnCopy: true}], dataMaskItems: [{groups: ['*'], udf: mask_email}]}
- {name: own, enabled: true, resources: [{table: '*', column: 'em*'}], dataMaskItems: [{users: [zed], udf: mask_text}]}
"""))
    with pytest.raises(GovernanceError) as e:
        g.run(ANN, "CREATE TABLE default.cp2 AS SELECT id, email FROM customer")
    assert e.value.code is Code.CONFIG_ERROR and not spark.catalog.tableExists("default.cp2")


def test_names_of_two_and_three_parts(spark):
    a = spark.createDataFrame([(1, "ann")], "id long, name string")
    b = spark.createDataFrame([(1, "bob"), (2, "cy")], "id long, name string")
    g = Governance(spark, {"crm.public.customer": a, "crm.other.customer": b, "crm.public.orders": b.withColumnRenamed("name", "note")}, load_policies("""
policies:
- {name: n, resources: [{schema: public, table: customer, column: name}], dataMaskItems: [{groups: ['*'], udf: mask_text}]}
- {name: f, resources: [{schema: other, table: customer}], rowFilterItems: [{groups: ['*'], condition: 'id > 1'}]}
"""), "crm", "public")
    rows = lambda sql: sorted(map(tuple, g.secure_sql(ANN, sql).collect()))
    assert rows("SELECT id, name FROM crm.public.customer") == rows("SELECT customer.id, name FROM public.customer WHERE customer.id = 1") == [(1, "***")]
    assert rows("SELECT crm.public.customer.name FROM crm.public.customer") == [("***",)]
    assert rows("SELECT c.name FROM other.customer c, `crm`.`public`.orders AS o WHERE c.id = o.id AND note <> 'other.customer'") == [("cy",)]
    assert rows("WITH customer AS (SELECT 7 AS id) SELECT c.id FROM customer c UNION ALL SELECT id FROM other.customer") == [(2,), (7,)]
    assert rows("SELECT note FROM orders WHERE id = ( SELECT max(id) FROM other.customer )") == [("cy",)]
    for sql in ("SELECT * FROM customer", "SELECT * FROM nope.customer", "SELECT * FROM a.b.c.d"):
        with pytest.raises(GovernanceError):
            g.plan(ANN, sql)


def test_top_and_parameters(g):
    assert [r.id for r in g.secure_sql(ANN, "SELECT TOP 1 id, phone FROM customer").collect()] == [1]
    assert g.secure_sql(ANN, "SELECT id FROM customer WHERE id = ?", [2]).first().id == 2
    assert g.secure_sql(ANN, "SELECT phone FROM customer WHERE id = :who", {"who": 2}).first().phone == "139****1111"


@pytest.mark.parametrize("policy", [
    "{name: p, resources: [{table: customer}], rowFilterItems: [{groups: ['*'], condition: 'nope = 1'}]}", "{name: p, resources: [{table: customer, column: email}], dataMaskItems: [{groups: ['*'], udf: mask_email, arguments: [1, 2]}]}",
    "{name: p, resources: [{table: customer, column: email}], dataMaskItems: [{groups: ['*'], udf: mask_phone, arguments: ['3', '4']}]}", "{name: p, resources: [{table: customer, column: email}], dataMaskItems: [{groups: ['*'], udf: mask_hash, arguments: [crc]}]}",
])
def test_bad_policies_fail_at_load(g, policy):
    with pytest.raises(GovernanceError) as e:
        Governance(g.spark, {"customer": g.tables[g.full_name("customer")]}, load_policies(f"policies: [{policy}]"))
    assert e.value.code is Code.CONFIG_ERROR


def test_sessions_are_bounded(g, monkeypatch):
    from wardstone.plans import session

    monkeypatch.setattr(session, "SESSIONS", 3)
    for k in range(6):
        g.session(Subject(f"u{k}"))
    assert len(g._sessions) <= 3 and g.session(Subject("u5")) is g.session(Subject("u5"))


def test_options_and_submitters(g, spark):
    from wardstone.operators.catalog import Options, Submitters

    with pytest.raises(GovernanceError):
        Options(on_failure="MAYBE")
    sql = "SELECT id IN (SELECT customer_id FROM orders) AS z FROM customer"
    free = Governance(spark, {t[2]: df for t, df in g.tables.items()}, [])
    for governance, mode, ok in ((g, "PASSTHROUGH", False), (free, "REFUSE", False), (free, "PASSTHROUGH", True)):
        gateway = Gateway(governance, options=Options(on_failure=mode))
        if ok:
            assert len(gateway.query(ANN, sql)["rows"]) == 3
        else:
            with pytest.raises(GovernanceError) as e:
                gateway.query(ANN, sql)
            assert e.value.code is Code.LINEAGE_UNKNOWN
    ways = Submitters(spark="a", other="b")
    assert ways.get(" ") == "a" and ways.get("other") == "b"
    with pytest.raises(GovernanceError):
        ways.get("jdbc2")
    assert not gateway.cancel("nothing") and gateway.running() == []


def test_function_import():
    from wardstone.operators.catalog import import_functions

    a, b, c, bad = Signature("f", ("string",)), Signature("f", ("string", "int")), Signature("g", ("string",)), Signature("h h", ("string",))
    out, report = import_functions({a}, {a, b, c, bad, Signature("k", ("geometry",))})
    assert out == {a, b, c} and report == {"created": ["g"], "updated": ["f"], "skipped": ["h h", "k"]}
    assert import_functions({a}, {a}) == ({a}, {"created": [], "updated": [], "skipped": ["f"]})


def test_policy_import():
    from wardstone.plans.policy import merge_policies

    text = "policies: [{name: %s, resources: [{table: t, column: c}], dataMaskItems: [{groups: ['*'], udf: %s}]}]"
    one, two, other = (load_policies(text % x)[0] for x in (("a", "mask_text"), ("a", "mask_name"), ("b", "mask_text")))
    assert merge_policies([one], [two, other]) == ([two, other], {"created": ["b"], "updated": ["a"], "unchanged": []})
    assert merge_policies([one], [one])[1]["unchanged"] == ["a"]
    for mixed in ("policies: []\nrowFilters: {c.s.t: 'x = 1'}", "policies: []\ncolumns: {c.s.t.a: m}"):
        with pytest.raises(GovernanceError):
            load_policies(mixed)


def test_structures(spark, tmp_path):
    from wardstone.sources.metadata import Structures, catalog_query, function_query, signatures

    store, text = Structures(spark, str(tmp_path / "s")), "tables: [{catalog: c, schema: s, name: t, columns: [{name: a, type: %s}]}]"
    assert [store.replace("one", text % t) for t in ("int", "string")] == [1, 2] and store.replace("two", text % "int") == 1
    version, tables = store.get("one")
    assert version == 2 and tables[("c", "s", "t")]["a"].dataType.simpleString() == "string"
    for bad in ("tables: []", text % "nope"):
        with pytest.raises(GovernanceError):
            store.replace("one", bad)
    with pytest.raises(GovernanceError) as e:
        store.get("three")
    assert e.value.code is Code.METADATA_INSTANCE_NOT_FOUND
    assert "pg_matviews" in catalog_query("postgresql") and "VIEW'" in catalog_query("trino", views=False) and "performance_schema" in catalog_query("mysql")
    with pytest.raises(GovernanceError):
        function_query("trino")
    rows = spark.createDataFrame([("s", "f", "f_1", 2, "int"), ("s", "f", "f_1", 1, "text"), ("s", "g", "g_1", None, None)], "routine_schema string, routine_name string, specific_name string, position int, data_type string")
    assert {(r.name, tuple(r.arguments)) for r in signatures(rows).collect()} == {("f", ("text", "int")), ("g", ())}


def test_stored_policies_and_grants(spark, tmp_path):
    from wardstone.sources.store import Store

    store, text = Store(spark, str(tmp_path / "state")), "policies: [{name: a, resources: [{table: t, column: c}], dataMaskItems: [{groups: ['*'], udf: %s}]}]"
    assert store.policies("one") == [] and store.grants("one") == set()
    assert store.import_policies("one", text % "mask_text")["created"] == ["a"]
    assert store.import_policies("one", text % "mask_text")["unchanged"] == ["a"]
    assert store.import_policies("one", text % "mask_name")["updated"] == ["a"]
    assert store.policies("one") == load_policies(text % "mask_name") and store.policies("one", 1) == load_policies(text % "mask_text")
    with pytest.raises(GovernanceError):
        store.policies("one", 3)
    own = {Grant("ann", "c.s.t", "SELECT")}
    assert store.save_grants("one", own) == 1 and store.grants("one") == own and store.grants("two") == set()
