"""Hot keys, odd rows and clashing names, beyond what test_operators holds against brute force."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from wardstone.llm import _skew, _store, byte_bpe, html_text, line_dedup, quality_rules, simhash, suffix_dedup, wu_manber
from wardstone.llm.factorization import quality_scores


def words(seed, n, vocabulary=40):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


@pytest.mark.parametrize("many", [100, 0])
def test_spread_join_is_a_join(spark, many):
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 == 0 else rng.choice("abc")) for k in range(200)] + [(None, "hot"), (7, None)]
    left, right = spark.createDataFrame(rows, "id int, k string"), spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, v int")
    counted = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        plain = sorted(map(tuple, left.join(right, ["k"], how).select("id", "k", "v").collect()), key=repr)
        for hot in (10, 1000):
            assert sorted(map(tuple, _skew.spread_join(left, right, ["k"], counted, "n", "id", how, hot, many).select("id", "k", "v").collect()), key=repr) == plain


def test_hot_lines_and_fingerprints(spark):
    line = "This one line stands in a third of all the documents there are."
    texts = [f"{line}\nown text number {k}" if k % 3 == 0 else words(k, 20) if k % 3 == 1 else "the same text" for k in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same = lambda f: [sorted(map(tuple, f(hot).collect())) for hot in (2, 1 << 12)]
    a, b = same(lambda hot: line_dedup.line_dedup(df, hot=hot))
    assert a == b and sum(line in r[1] for r in a) == 1
    a, b = same(lambda hot: simhash.near_duplicates(df, hot=hot))
    assert a == b and len({r[2] for r in a if r[0] % 3 == 2}) == 1


@pytest.fixture(scope="module")
def coding():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merging_of_long_words(coding):
    ranks, _, encoding = coding
    rng = random.Random(2)
    for n in (1, 2, 300, 5000, 1_000_000):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        ids = byte_bpe.merge(word.encode(), ranks)
        assert b"".join(encoding.decode_single_token_bytes(i) for i in ids) == word.encode()
        if n <= 5000:
            assert ids == encoding.encode_ordinary(word)
    assert byte_bpe.merge(b"x" * 999, ranks) == encoding.encode_ordinary("x" * 999)


@pytest.mark.parametrize("frequent", [0, 5, 1 << 20])
def test_byte_bpe_either_way(spark, coding, monkeypatch, frequent):
    ranks, pattern, encoding = coding
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 40)
    texts = [None, "", " ", "漢字" * 300, "x" * 4000 + " " + "ab" * 700, "qzxqzx qzxqzx vrrbl vrrbl", "", words(3, 60, 9000), "-" * 300 + "\n" + "=" * 80, "don't  I'll\n\n"] * 2
    df = spark.createDataFrame([(k, t, "p", "d", 7, "f") for k, t in enumerate(texts)], "doc_id long, text string, packed string, decoded string, folded int, _found string")
    out = byte_bpe.byte_bpe(df, ranks, pattern, frequent=frequent)
    assert out.columns == ["doc_id", "text", "folded", "_found", "ids", "packed", "decoded"]
    for r in out.collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert (list(r.ids), bytes(r.packed), bytes(r.decoded), r.folded, r._found) == (ids, struct.pack(f"<{len(ids)}I", *ids), (r.text or "").encode(), 7, "f")


def test_byte_bpe_keeps_no_rank_map_in_plan_texts(spark, coding):
    """Spark keeps the texts of each plan that ran; the rank map stands in none, and no row carries it."""
    ranks, pattern, _ = coding
    df = spark.createDataFrame([(k, "vrrbl qzxqzx vrrbl w%d" % (k % 7)) for k in range(20)], "doc_id long, text string")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = byte_bpe.byte_bpe(df, ranks, pattern).select("doc_id", "ids")
    assert out.count() == len(out.collect()) == 20
    bus.waitUntilEmpty(30_000)
    kept = store.executionsList(int(before), int(store.executionsCount() - before))
    sizes = []
    for k in range(kept.size()):
        nodes = store.planGraph(kept.apply(k).executionId()).allNodes()
        sizes += [len(kept.apply(k).physicalPlanDescription()), *[len(nodes.apply(i).desc()) for i in range(nodes.size())]]
    assert len(sizes) > 4 and max(sizes) < 100_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and not any("AS _arrays" in line for line in plan.split("\n"))


def test_rules_judge_long_lines_as_short_ones(spark):
    rng = random.Random(5)
    prose = " ".join("w%d" % rng.randrange(400) + ("." if k % 9 == 0 else "") for k in range(20_000))
    again = "so it goes on and on and on here. " * 500
    df = spark.createDataFrame([(1, prose, "mine", 3), (2, again, "mine", 3)], "doc_id long, text string, lost string, own int")
    found = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert found[1].n_lines_failed == 0 and found[1].text == prose and found[2].n_lines_failed == 1 and found[2].text == ""
    assert (found[1].lost, found[1].own) == ("mine", 3)


def test_scores_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(df, labels, F.lit(True)).collect()} == {0.5}


def test_items_without_ids(spark):
    item = words(4, 13, 900)
    bench = spark.createDataFrame([(None, item), (None, "other words"), (3, item)], "item_id long, text string")
    (r,) = wu_manber.decontaminate(spark.createDataFrame([(1, item)], "doc_id long, text string"), bench).collect()
    assert list(r["items"]) == ["", "3"] and r.n_items == 2


def test_suffix_dedup_passes_all_columns(spark):
    df = spark.createDataFrame([(1, "x" * 500, 1, "r"), (2, "y", 2, "s")], "doc_id long, text string, doc int, runs string")
    assert [(r.n_bytes, r.n_removed, r.doc, r.runs) for r in suffix_dedup.suffix_dedup(df).orderBy("doc_id").collect()] == [(500, 500, 1, "r"), (1, 0, 2, "s")]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, tmp_path, stage):
    """Empty tables, repeated rows, null ids, and columns named like those that operators add."""
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kinds = "doc_id long, text string, lang string, n_chars long, n_lines string, kept string, n_words int, items int, drop int, packed string, ids int"
    text = "\n".join(words(k, 12, 900) + "." for k in range(9))
    rows = [(k, t, "en", 5, "l", "k", 1, 2, 3, "p", 4) for k, t in ((1, text), (1, text), (None, text), (None, None), (2, ""), (3, words(90, 99, 9000) + "."))]
    name, function = corpus_pipeline.STAGES[stage]
    assert function(spark, spark.createDataFrame([], kinds), str(tmp_path)).count() == 0
    out = function(spark, spark.createDataFrame(rows, kinds), str(tmp_path))
    found = out.collect()
    want = [c.split()[0] for c in kinds.split(", ")]
    assert out.columns == (want if name != "tokens" else [*want[:-1], "ids", "n_tokens", "round_trip"])
    assert all((r.n_lines, r.kept, r.drop, r.packed) == ("l", "k", 3, "p") for r in found)
    assert len(found) == {"quality rules": 4, "line dedup": 6, "near copies": 3, "benchmark": 6, "tokens": 6}[name]


def test_cuts_need_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        _store.shared_dir(Session())


def test_html_keeps_visible_text():
    assert html_text.render("<p title=Bob's>link</p><p>that's all</p><p>end</p>") == "link\n\nthat's all\n\nend"
    assert html_text.render("a<!-->b<!-- x -->c<!--->d") == "abcd"
    assert "shown" in html_text.render('<div style="visibility:hidden">no<b style="visibility:visible">shown</b></div>')
    assert html_text.render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert html_text.render('<p title=a"b>x</p><a href=/q?a=1&b="c>y</a>"') == 'x\n\ny"'
    assert html_text.render('<p title="open>never closed') == "" and html_text.render("<br/><b/>x<i =y>z") == "xz"
    assert html_text.render("<" + "a b" * 50_000) == "" and html_text.render("<p " + 'a="' * 20_000) == ""
    assert html_text.render("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()
