"""Each corpus operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties,
repeated rows, empty tables, and columns whose names clash."""

import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import byte_bpe, components, html_text, induced_sort, katz, line_dedup, quality_rules, simhash, suffix_dedup, toxicity, wu_manber
from wardstone.llm.factorization import quality_scores

SCHEMA = "doc_id long, text string, n_words string, drop string, fingerprint int"


def table(spark, texts, ids=None):
    """Rows with extra columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "mine", "d", 7) for i, t in zip(ids, texts, strict=True)], SCHEMA)


LINE = "The quick brown fox jumps over the lazy dog, again and again."
ODD = [None, "", " ", "\n\n", "a", "word " * 300, "x" * 70_000, "é" * 300 + "\n" + LINE, LINE, LINE]


def words(seed, n, vocabulary=40):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 50))
        t = np.concatenate([t, t]) if trial % 4 == 0 else t
        order = induced_sort.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = induced_sort.common_prefixes(t, order)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert shared[b] == k


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    base = words(1, 120)
    texts = [*ODD[:-3], base, "pre " + base, base[:250] + " tail", "z" * 400, "ab" * 900, words(2, 80), words(3, 30) + base[100:420]]
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(table(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for k, t in enumerate(raw):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        assert bytes(found[k].kept) == bytes(c for c, g in zip(t, gone, strict=True) if not g)
        assert found[k].n_spans == len([p for p in bytes(gone).split(b"\0") if p]) and found[k].n_words == "mine"
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0


def test_suffix_dedup_without_keys(spark):
    base = words(1, 120)
    own = [words(k, 200, 9000) for k in range(60, 63)]
    rows = [(None, base), (None, own[0]), (1, "pre " + base), (1, own[1]), (2, own[2])]
    found = suffix_dedup.suffix_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in found), key=repr) == sorted([(None, b""), (None, own[0].encode()), (1, b"pre "), (1, own[1].encode()), (2, own[2].encode())], key=repr)


def test_katz(spark):
    texts = [words(k, 60, 30) for k in range(12)] + ["", None, "new words only"]
    df = table(spark, texts)
    found = {r.doc_id: r for r in katz.katz_scores(df, F.col("doc_id") % 5 != 0, vocabulary=12).collect()}
    own = [katz.tokens((t or "").encode()) for t in texts]
    train = [t for k, t in enumerate(own) if k % 5]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(own):
        assert found[k].train_tokens == n and found[k].n_tokens == len(t) and found[k].n_known == sum(c[w] > 0 for w in t)
        assert found[k].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert np.isfinite(found[k].score)
    twice = katz.katz_scores(table(spark, ["a b", "a b", None], [1, 1, None]), F.lit(True)).collect()
    assert len(twice) == 3 and {r.n_tokens for r in twice} == {1, 3}
    assert katz.katz_scores(table(spark, []), F.lit(True)).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk": 300, "part_tokens": 150, "hot_over": 30}])
def test_katz_has_bigrams_of_every_word(spark, sizes):
    rng = random.Random(6)
    texts = [" ".join("w%d" % int(rng.paretovariate(0.6)) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", None, "unseen1 w1 unseen2 w2"]
    own = [katz.tokens((t or "").encode()) for t in texts]
    train = [t for k, t in enumerate(own) if k % 5 and k < 62]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b"start", *t], t, strict=False))
    whole, histories = sum(c.values()) + len(c) + 1, Counter(c) | Counter({b"start": len(train)})
    factors = katz.discounts(Counter(pairs.values()))
    after = {}
    for (h, w), n in pairs.items():
        after.setdefault(h, {})[w] = n * factors[n - 1] if n <= katz.K else n

    def log_p(h, w):
        p1 = (c[w] + 1) / whole
        if h not in after:
            return np.log10(p1)
        kept = sum(after[h].values()) / histories[h]
        goal = min(kept, histories[h] / (histories[h] + 1))
        if w in after[h]:
            return np.log10(after[h][w] / histories[h] * goal / kept)
        return np.log10((1 - goal) / (1 - sum((c[x] + 1) / whole for x in after[h])) * p1)

    assert any(n == 1 for n in c.values()) and len(c) > 40
    learns = (F.col("doc_id") % 5 != 0) & (F.col("doc_id") < 62)
    for vocabulary in ({}, {"vocabulary": 12}):
        found = {r.doc_id: r.score for r in katz.katz_scores(table(spark, texts), learns, **vocabulary, **sizes).collect()}
        assert len(found) == len(texts)
        for k, t in enumerate(own):
            assert found[k] == pytest.approx(sum(log_p(h, w) for h, w in zip([b"start", *t], t, strict=False)))


def test_backoff_is_normalised():
    history, p1 = np.array([10.0, 4.0, 0.0]), np.array([0.5, 0.3, 0.2])
    counts = np.array([[7, 3, 0], [2, 1, 1], [0, 0, 0]])
    factors = katz.discounts(Counter(counts[counts > 0].tolist()))
    kept = katz._discounted(counts, factors)
    weight, scale = katz.backoff(history, kept.sum(1), (p1 * (counts > 0)).sum(1))
    for h in range(2):
        assert np.where(counts[h] > 0, kept[h] * scale[h] / history[h], weight[h] * p1).sum() == pytest.approx(1)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_wu_manber(spark, block):
    items = [(1, words(9, 40, 500)), (2, "one two"), (3, None), (4, words(10, 14, 500)), (5, "!!"), (5, words(11, 13, 500)), (10, "a")]
    texts = [*ODD, items[0][1], "x " + items[3][1] + " y", "One, TWO three", "one twofold", " ".join(items[0][1].split()[:12]), items[5][1].upper() + " " + words(3, 400, 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in wu_manber.decontaminate(table(spark, texts), bench, block_bytes=block).collect()}
    for k, t in enumerate(texts):
        n, hit, names = wu_manber.brute_force(t, items)
        assert (found[k].n_words, found[k].n_hit, list(found[k]["items"])) == (n, hit, names)
        assert found[k].contaminated == (hit > 0 and 20 * hit >= n)
    assert wu_manber.decontaminate(table(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in wu_manber.decontaminate(table(spark, ["a"]), bench.limit(0)).collect())


def component_ids(prints, reach=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= reach:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash(spark):
    base = words(1, 300, 900).split()
    rng = random.Random(4)
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in (rng.randrange(300) for _ in range(40))]
    texts = [*ODD, *near, *[words(k, 50, 900) for k in range(40)]]
    df = table(spark, texts)
    found = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert [found[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[k].component_id for k in range(len(texts))] == component_ids(prints)
    kept = simhash.simhash_dedup(df.union(df.where("doc_id = 12")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component_ids(prints)))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_dedup_without_keys(spark):
    a, b, c, d, e = (words(k, 50, 900) for k in range(50, 55))
    rows = [(None, a), (None, b), (None, a), (5, c), (5, d), (7, e), (None, e), (6, e), (5, c)]
    kept = simhash.simhash_dedup(table(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, a), (None, b), (5, c), (5, d), (6, e)], key=repr)
    assert kept.columns == table(spark, []).columns


def test_fingerprint_bits():
    import xxhash

    text = "A b  C d\te"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d e")]
    want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > 3)
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b"") == 0


@pytest.mark.parametrize("few", [1 << 24, 0])
def test_links_and_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(2)
    prints = {0}
    for _ in range(150):
        p = 0
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints | {int(x) for x in rng.integers(0, 1 << 62, 100)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    stars = {r.node: r.root for r in components.components(simhash.links(df, "fp", tile=40)).collect()}
    groups = Counter(stars.get(simhash._signed(p), simhash._signed(p)) for p in prints)
    assert sorted(groups.values()) == sorted(Counter(component_ids(prints)).values())


def test_line_dedup(spark):
    other = "Another line that is long enough to be counted as shared text."
    texts = [LINE + "\nown %d" % k for k in range(4)] + ["\t" + LINE.upper() + " \n" + other, other, other, other, *ODD]
    found = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, texts)).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for k, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(k)
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == k]
        assert (found[k].text, found[k].n_lines, found[k].n_dropped, found[k].drop) == ("\n".join(kept), len(lines), len(lines) - len(kept), "d")
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_byte_bpe(spark):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "don't  I'll\n\n x ", "é漢字 123٣ 😀 <|endoftext|>", "b" * 200 + " qzxqzx", LINE, LINE, "anewword qqjx anewword"]
    for r in byte_bpe.byte_bpe(table(spark, texts), ranks, public_tokenizers.PATTERN).collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert list(r.ids) == ids and bytes(r.decoded) == (r.text or "").encode() and bytes(r.packed) == struct.pack(f"<{len(ids)}I", *ids)
    assert byte_bpe.byte_bpe(table(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_quality_rules(spark):
    clean = "\n".join(" ".join("w%d" % (k * 9 + j) for j in range(9)) + "." for k in range(10))
    nav = "\n".join("Home | About | Contact | More | k%d" % k for k in range(30))
    texts = [clean, nav, clean + "\n" + "All rights reserved.", clean.upper().replace(" ", "!! "), *ODD]
    found = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, texts)).collect()}
    assert found[0].kept and found[0].text == clean and not found[1].kept and found[2].kept and found[2].text == clean and not found[3].kept
    for k, t in enumerate(texts):
        own = [w for w in (t or "").replace("\x0b", " ").split() if w]
        windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
        repeat = {j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = found[k]
        assert (r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(repeat), len(lines) - len(set(lines)), sum(map(len, own)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.base_failed == (len(own) < 50 or 2 * len(repeat) > len(own))
    assert quality_rules.keep_clean(table(spark, texts)).count() == sum(r.kept for r in found.values())
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_html():
    page = "<title>no</title><p>a<p>b <b>c</b>d<ul><li>x<li>y<ol start=3><li>q</ol></ul><table><tr><th>n<th>long<tr><td>12<td>b</table>tail<div hidden>no</div><script>'</p>'</script><pre>a\n  b</pre>&lt;x&gt; 1 < 2<br>z"
    assert html_text.render(page) == "a\n\nb cd\n\n- x\n- y\n  3. q\n\nn   long\n12  b\n\ntail\n\na\n  b\n\n<x> 1 < 2\nz"
    assert html_text.render("") == "" and html_text.render("plain   text") == "plain text" and html_text.render("<div>" * 3000 + "x") == "x"


@pytest.mark.parametrize("attributes", ['title="The hidden cost of x"', 'class="menu hidden large"', 'data-style="display:none"', "aria-hidden=true", 'aria-hidden="true"', 'data-type="hidden"', "title='style=\"display:none\"'", 'style="display:none;display:block"', 'style="background:url(a;display:none;b)"', "type=hidden", 'style="--display:none"'])
def test_html_shows(attributes):
    assert html_text.render(f"a<div {attributes}>b<p>c</p></div>d") == "a\nb\n\nc\n\nd"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'class=x hidden=""', "hidden/", 'style="color:red; DISPLAY : None"', "style='visibility:hidden'", "style=display:none", 'style="display:none!important;display:block"', 'style="/* a; */display&#58;none"'])
def test_html_hides(attributes):
    assert html_text.render(f"a<div {attributes}>b<p>c</p></div>d").replace("\n", "") == "ad"


def test_html_numbers_by_name():
    assert html_text.render('<ol data-start=7 title="start=5"><li>a</ol>') == "1. a" and html_text.render("<ol start='4'><li>a</ol>") == "4. a"
    assert html_text.render('<table><tr><td data-colspan=2>a<td>b<tr><td colspan="2">c<td>d</table>') == "a  b\nc     d"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "<p>x", 5)], "page_id long, html string, text int")
    assert [r.text for r in html_text.extract_text(df).collect()] == ["", "", "x"]


def learnable(spark):
    good = [words(k, 80, 300).capitalize() + "." for k in range(60)]
    bad = [("BUY!! " * 40 + words(k, 10)).strip() for k in range(60)]
    df = table(spark, [*good, *bad, None, "", "x" * 5000])
    labels = spark.createDataFrame([(k, int(k < 60), int(k >= 60)) for k in range(120)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    return df, labels


def test_classifiers(spark):
    df, labels = learnable(spark)
    usable = F.col("doc_id") % 5 != 0
    scores = {r.doc_id: r.score for r in quality_scores(df, labels, usable).collect()}
    assert len(scores) == 123 and all(0 <= s <= 1 for s in scores.values())
    assert min(scores[k] for k in range(0, 60, 5)) > 0.5 > max(scores[k] for k in range(60, 120, 5))
    found = {r.doc_id: r for r in toxicity.toxicity(df, labels, usable).collect()}
    assert not any(found[k].toxic for k in range(60)) and all(found[k].toxic for k in range(60, 120, 5))
    assert all(0 <= r.expected_severity <= 3 for r in found.values())
    assert quality_scores(df.limit(0), labels, usable).count() == 0 and {r.score for r in quality_scores(df, labels.limit(0), usable).select("score").limit(3).collect()} != set()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    own = lambda seed: "\n".join(words(seed * 50 + k, 12, 9000) + "." for k in range(9))
    item = words(77, 20, 9000)
    texts = [*[own(k) for k in range(6)], own(0), own(2) + "\n" + item, None, "", "a | b | c | d\n" * 60, *[own(20 + k) + "\n" + LINE for k in range(6)]]
    spark.createDataFrame([(k, t, "en", None, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    rest = {k: t for k, t in enumerate(texts) if t and "|" not in t}
    rest = {k: t if k == max(rest) else t.replace("\n" + LINE, "") for k, t in rest.items()}
    ids = sorted(rest)
    roots = component_ids([simhash.fingerprint(rest[k].encode()) for k in ids])
    rest = {k: rest[k] for k, r in zip(ids, roots, strict=True) if ids[r] == k}
    rest = {k: t for k, t in rest.items() if not (h := wu_manber.brute_force(t, [(1, item)]))[1] or 20 * h[1] < h[0]}
    assert {k: r.text for k, r in out.items()} == rest and all(r.round_trip and r.n_chars == len(r.text) for r in out.values())
