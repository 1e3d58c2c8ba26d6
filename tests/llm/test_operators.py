"""Each operator beside a plain repetition of it, and on odd rows."""

import hashlib
import math
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from riskloom.catalog.check import compare, sql_connection  # noqa: E402
from riskloom.llm import (  # noqa: E402
    bpe, components, eliasfano, lm, mainpage, mixing, neighbours, quality, secrets, simhash, tokenfile, urlrules,
)
from riskloom.llm.queries import ORACLES, QUERIES, WORD_BPE  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def keyed(rows, key="doc_id"):
    return {r[key]: r for r in rows.collect()}


def test_names():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    want = sql_connection(FOLDER).execute(ORACLES[name]).to_arrow_table()
    assert compare(QUERIES[name](spark, FOLDER).toArrow(), want) == ""


def test_quality_counts(spark, texts, odd_docs, no_docs):
    found = keyed(QUERIES["op1_quality_rules"](spark, FOLDER))
    assert set(found) == set(texts)
    for key, text in texts.items():
        r = found[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.base_counts(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    odd = quality.judge(odd_docs)
    assert odd.count() == 12 and odd.filter("kept is null or base_failed is null").count() == 0
    assert quality.judge(no_docs).count() == 0
    assert quality.kept_documents(odd_docs).columns == odd_docs.columns


def test_quality_keeps_labelled_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    judged = rows.filter("not base_failed")
    assert judged.filter("quality = 1 and not kept").count() == 0
    bad = judged.filter("quality = 0")
    assert bad.filter("not kept").count() >= 0.5 * bad.count()


def test_distance_is_jensen_shannon(spark):
    row = spark.range(1).select(quality.distance(F.array(F.lit(1), F.lit(3)), F.array(F.lit(2), F.lit(0))).alias("d")).first()
    p, q = np.array([0.25, 0.75]), np.array([1.0, 0.0])
    m = (p + q) / 2
    want = math.sqrt((sum(a * math.log2(a / b) for a, b in zip(p, m, strict=True) if a) + math.log2(1 / m[0])) / 2)
    assert row["d"] == pytest.approx(want)


def test_lm_scores_on_odd_rows(odd_docs, no_docs):
    found = lm.score(odd_docs).collect()
    assert len(found) == 12
    assert sorted(r["n_words"] for r in found) == sorted(len(brute.words(r["text"])) for r in odd_docs.collect())
    assert all(r["log_score"] == 0 for r in found if not r["n_words"])
    assert lm.score(no_docs).count() == 0


def test_lm_third_order(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "x b c")], "doc_id long, text string")
    found = {r["doc_id"]: r["log_score"] for r in lm.score(docs, order=3).collect()}
    n, log = 10, math.log
    back = log(0.4)
    start = {1: log(2 / 3), 2: log(2 / 3), 3: log(1 / n) + back}  # of the first word after the start
    second = {1: log(2 / 2), 2: log(2 / 2), 3: 2 * back + log(3 / n)}
    third = {1: log(2 / 2), 2: log(2 / 2), 3: back + log(3 / 3)}
    fourth = {1: 0, 2: 2 * back + log(1 / n), 3: 0}
    for key in found:
        assert found[key] == pytest.approx(start[key] + second[key] + third[key] + fourth[key])


def check_codes(rows, library):
    for key, text, ids, decoded in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, key
        assert decoded == library.decode(want, skip_special_tokens=False), key


def test_bpe_equals_library(spark, library, odd_docs, no_docs, texts):
    coded = bpe.encode_decode(odd_docs, VOCABULARY).collect()
    assert len(coded) == 12
    by_key = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"]}
    check_codes([(r["doc_id"], by_key[r["doc_id"]], r["ids"], r["decoded"]) for r in coded if r["doc_id"]], library)
    assert bpe.encode_decode(no_docs, VOCABULARY).count() == 0
    found = keyed(QUERIES["op3_bpe_encode_decode"](spark, FOLDER))
    for key, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[key]["n_tokens"] == len(ids)
        assert found[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_random_texts(library):
    codec, rng = bpe.Codec(VOCABULARY), np.random.default_rng(3)
    letters = list("abcdeé'sST12 \t\n$#<|>Ωσς́ ÅKıİ漢字👍🏽--||") + ["<|endoftext|>", "e" * 80, "<|startoftext|>x"]
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        check_codes([(text, text, codec.encode(text.encode()), codec.decode(codec.encode(text.encode())))], library)


def test_no_token_spans_a_cut():
    codec = bpe.Codec(VOCABULARY)
    assert codec.cuts("zq") or ("z", "q") in codec.inside
    for token in list(codec.vocabulary)[:2000]:
        assert codec.cuts(token.removesuffix(codec.end)) == [] or token in codec.special


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (1, 50, 10**6, 10**15):
        for n in (0, 1, 2, 700):
            numbers = np.sort(rng.integers(-top, top, n))
            packed = eliasfano.EliasFano.from_bytes(eliasfano.EliasFano.of(numbers).to_bytes())
            assert packed.numbers().tolist() == numbers.tolist()
            assert [packed.select(i) for i in range(n)] == numbers.tolist()
    steady = eliasfano.EliasFano.of(np.arange(0, 100_000 * 512, 512))
    assert len(steady.to_bytes()) < 100_000 * 11.1 / 8 + 64


def test_token_files(spark, library, odd_docs, no_docs, texts):
    found, start = keyed(QUERIES["op9_token_files"](spark, FOLDER)), 0
    for key in sorted(texts):
        ids = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        r = found[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd = sorted(tokenfile.read_shards(tokenfile.write_shards(odd_docs, VOCABULARY)).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in odd] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["start"] for r in odd] == [0, *np.cumsum([r["n_tokens"] for r in odd])[:-1]]
    assert tokenfile.read_shards(tokenfile.write_shards(no_docs, VOCABULARY)).count() == 0
    with pytest.raises(TypeError):
        tokenfile.write_shards(odd_docs.withColumn("doc_id", F.lit("x")), VOCABULARY)


def test_token_files_of_several_parts(spark, library):
    texts = ["b a", "a b c don't", "", None, "Zebra! 12", "é漢字 <|endoftext|>x"] * 40
    rows = [(k // 3 if k % 7 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shards = tokenfile.write_shards(docs.limit(240), VOCABULARY, most=1)
    found = tokenfile.read_shards(shards).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r["key"] for r in found] == [k for k, _ in want]
    for r, (_, text) in zip(found, want, strict=True):
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1]]


def test_generations_forget_the_oldest():
    held = tokenfile.Generations(2)
    for k in (1, 2, 3, 4):
        held.add({k: k})
        held.get([2])
    assert held.get([2, 1, 5]) == [2, None, None]


PAGE = (
    '<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>'
    '<nav><a href="/">Home page</a></nav><div class="cookie-notice">We use cookies here</div>{}'
    '<aside>Read more of this</aside><form><label>Mail</label><input name=q></form>'
    '<section id="comments"><p>first comment by a reader of this page</p></section><footer>&copy; us</footer></body></html>'
)
ARTICLE = "<article><h1>A  title&nbsp;of it</h1><p>Some <b>bold</b>er words &lt;here&gt; and\nmore.<p>Second one &amp; last<br>line of it</article>"


def test_main_text(spark):
    want = "A title of it\nSome bolder words <here> and more.\nSecond one & last line of it"
    rows = [(1, "u", PAGE.format(ARTICLE)), (2, None, None), (3, "u", ""), (4, "u", "<p"), (1, "u", PAGE.format(ARTICLE)), (5, "u", PAGE.format(ARTICLE)[: -len("</body></html>")]), (6, "", PAGE.format(""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [(r["page_id"], r["_text"]) for r in mainpage.main_texts(pages).collect()]
    assert sorted(found) == [(1, want), (1, want), (2, ""), (3, ""), (4, ""), (5, want), (6, "")]
    assert mainpage.main_texts(pages.limit(0)).count() == 0


def test_main_text_without_article_mark(spark):
    costs = mainpage.fit_costs(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    body = '<div id="content"><h2>About it</h2>' + "<p>Many words in a long paragraph of a page that has something to say.</p>" * 5 + "</div>"
    text = mainpage.extract(PAGE.format(body), costs)
    assert text.startswith("About it\nMany words") and text.count("\n") == 5 and "comment" not in text


def test_main_text_of_given_pages(spark):
    for r in QUERIES["op4_html_main_text"](spark, FOLDER).collect():
        assert r["n_chars"] == len(r["text"]) > 0


def test_mix(spark, texts, odd_docs, no_docs):
    rows = pd.DataFrame([r.asDict() for r in QUERIES["op5_mix_sources"](spark, FOLDER).collect()]).set_index("doc_id")
    again = pd.DataFrame([r.asDict() for r in QUERIES["op5_mix_sources"](spark, FOLDER).collect()]).set_index("doc_id")
    assert (rows.sort_index() == again.sort_index()).all().all()
    assert rows["size"].to_dict() == {k: len(brute.words(t)) for k, t in texts.items()}
    assert (rows.taken <= 2 * rows["size"]).all()
    rows["source"] = pd.Series({r["doc_id"]: r["source"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()})
    sums = rows.groupby("source").agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    want = brute.targets(sums["size"].to_dict())
    for source, r in sums.iterrows():
        assert r["target"] == pytest.approx(want[source])
        assert abs(r["taken"] - r["target"]) <= 3 * mixing.BLOCK_WORDS
    placed, pieces = mixing.mix(odd_docs)
    taken = mixing.taken_words(placed, pieces)
    assert taken.count() == 12 and taken.filter("taken > 2 * size").count() == 0
    placed, pieces = mixing.mix(no_docs)
    assert mixing.taken_words(placed, pieces).count() == 0


def test_mixed_documents(odd_docs, no_docs):
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    placed, pieces = mixing.mix(odd_docs)
    sums = {r["key"]: r["n"] for r in mixing.taken_words(placed, pieces).groupBy("key").agg(F.sum("taken").alias("n")).collect() if r["n"]}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == sums
    assert mixing.mixed_documents(no_docs).count() == 0


def test_permutation(spark):
    for size in (1, 2, 3, 97, 4096):
        rows = spark.range(size).select(F.lit(1).alias("rank"), F.col("id").alias("n"), F.lit(size).cast("long").alias("size"))
        found = [r["n"] for r in mixing.permuted(rows, "n", "size", 5).collect()]
        assert sorted(found) == list(range(size))
        assert size < 50 or found != sorted(found)


def test_secrets(spark, texts, odd_docs, no_docs):
    found = keyed(QUERIES["op6_secret_scans"](spark, FOLDER))
    names = ("assign", "access", "hex")
    rows = [(found[k], t) for k, t in texts.items()]
    odd = secrets.scan(odd_docs).withColumn("written", secrets.written(F.col("_spans")))
    assert odd.count() == 12
    for r, text in rows:
        spans = brute.secret_spans(text)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        written = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    for r in odd.collect():
        assert r["written"] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in brute.secret_spans(r["text"]))
    clean = {r["doc_id"]: r for r in secrets.redacted(odd_docs).collect()}
    assert clean[8]["text"] == "[secret] secret: short [secret] [secret]"
    assert clean[8]["n_chars"] == len(clean[8]["text"]) and clean[2]["text"] is None
    assert secrets.redacted(no_docs).count() == 0


def test_markov_models_on_held_out_strings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    ratios = secrets.train(secrets.labelled_strings(docs.filter(part == 0)))
    held = secrets.labelled_strings(docs.filter(part == 1)).filter(F.char_length("value") >= secrets.CANDIDATE)
    judged = held.select("random", (secrets.mean_ratio(F.col("value"), ratios) > secrets.RATIO).alias("found"))
    rates = {r["random"]: r["rate"] for r in judged.groupBy("random").agg(F.avg(F.col("found").cast("int")).alias("rate")).collect()}
    assert rates[True] > 0.95 and rates[False] < 0.01
    text = "see dGhpc0lzQVJhbmRvbVN0cmluZzEyMzQ1Njc4 now, the internationalization_of_names"
    odd = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.scan(odd, ratios).first()["_more"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["dGhpc0lzQVJhbmRvbVN0cmluZzEyMzQ1Njc4"]


def test_simhash(spark, texts, odd_docs, no_docs):
    found = keyed(QUERIES["op7_simhash_near_dedup"](spark, FOLDER))
    prints = {k: brute.fingerprint(t) for k, t in texts.items()}
    assert {k: r["fingerprint"] for k, r in found.items()} == {k: f"{v:016x}" for k, v in prints.items()}
    want = brute.groups(sorted(prints.items()), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {k: r["component_id"] for k, r in found.items()} == want
    odd = simhash.near_groups(odd_docs)
    assert odd.count() == 12
    by_key = {r["doc_id"]: r["component_id"] for r in odd.collect() if r["doc_id"]}
    assert by_key[2] == by_key[3] == by_key[4] == 2 and by_key[7] == 7
    assert simhash.near_groups(no_docs).count() == 0
    assert simhash.one_per_group(odd_docs).columns == odd_docs.columns


def test_tiles_of_many_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    values = {int(b) ^ (1 << int(i) if i < 63 else 0) ^ (1 << int(j) if j < 63 else 0) for b in base for i, j in rng.integers(0, 64, (12, 2))}
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    links = simhash.near_links(prints, block=3)
    found = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute.groups([(v, v) for v in sorted(values)], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {v: found.get(v, v) for v in values} == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    edges = spark.createDataFrame(chain, "source long, target long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    found = pd.DataFrame([r.asDict() for r in QUERIES["op8_nearest_neighbours"](spark, FOLDER).collect()])
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        apart = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        apart[i] = np.inf
        want = ids[np.lexsort((ids, apart))[:10]]
        own = found[found.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 14))
        assert np.allclose(own.score, [apart[ids == v][0] for v in own.vec_id], rtol=1e-12)
        hits, total = hits + len(set(want) & set(own.vec_id)), total + 10
    assert hits >= 0.9 * total


def test_nearest_with_equal_and_odd_vectors(spark):
    rows = [(100, [1.0, 0.0])] + [(k, [1.0, 0.0]) for k in range(1, 40)] + [(50, [0.0, 1.0]), (60, None), (70, [0.0, 0.0]), (80, [float("nan"), 1.0]), (90, [None, 1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    found = neighbours.nearest(vectors).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(k, k, 0.0) for k in range(1, 11)]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.nearest(few).collect()] == [(0, 1)]
    assert neighbours.nearest(vectors.limit(0)).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/y">'),
        (2, "http://B.com/y#z", ""),
        (3, "https://c.com/1", '<meta http-equiv="refresh" content="0; url=http://b.com/y">'),
        (4, None, None),
        (5, "no scheme", "<link href='/q' rel='canonical'>"),
        (6, "http://e.com/r", "<link rel=canonical href=http://f.org/fr/>"),
        (7, "http://e.com/r2?a=://b", "<link rel=canonical href=/r><meta http-equiv=refresh content='1;URL=http://z.net/'>"),
        (8, "http://www.example.net/en/1?q", None),
        (9, "http://www.example.net/EN/", None),
        (10, "http://internet/", None),
        (11, "http://x.net", None),
        (7, "http://e.com/r2?a=://b", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages).na.fill("-").collect())
    assert found == [
        (1, "a.net", "/x", "net/", "block"),
        (2, "b.com", "/y", "-", "block"),
        (3, "c.com", "/1", "-", "block"),
        (4, "", "", "-", "allow"),
        (5, "", "", "-", "allow"),
        (6, "e.com", "/r", "-", "allow"),
        (7, "e.com", "/r2", "-", "allow"),
        (7, "e.com", "/r2", "-", "allow"),
        (8, "www.example.net", "/en/1", "example.net/en/", "allow"),
        (9, "www.example.net", "/EN/", "net/", "block"),
        (10, "internet", "/", "-", "allow"),
        (11, "x.net", "", "-", "allow"),
    ]
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_pipeline(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    coded = corpus_pipeline.run(spark, FOLDER).collect()
    judged = {r["key"] for r in quality.judge(docs).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in judged}
    prints = sorted((k, brute.fingerprint(t)) for k, t in texts.items())
    heads = set(brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 2).values())
    assert {r["doc_id"] for r in coded} <= heads
    assert len({r["doc_id"] for r in coded}) > 0.5 * len(heads)
    whole = {k: library.encode(texts[k], add_special_tokens=False).ids for k in heads if not brute.secret_spans(texts[k])}
    same = [r for r in coded if r["doc_id"] in whole and np.frombuffer(r["ids"], "<u4").tolist() == whole[r["doc_id"]]]
    assert same and all(r["n_tokens"] == len(r["ids"]) // 4 for r in coded)


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(5)
    x = 1 + rng.normal(size=(40, 6)) * 1e-3
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(40)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, every=20, wanted=39).collect()
    assert len(found) == 2 * 39
    for row in found:
        assert row["score"] == pytest.approx(np.sqrt(((x[row["query_id"]] - x[row["vec_id"]]) ** 2).sum()), rel=1e-12)


def test_near_dedup_stage(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = sorted((r["doc_id"], brute.fingerprint(r["text"])) for r in docs.collect())
    stage = corpus_pipeline.near_dedup(spark, docs, "")
    assert stage.columns == docs.columns
    assert {r["doc_id"] for r in stage.collect()} == set(brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 2).values())
    odd = corpus_pipeline.near_dedup(spark, odd_docs, "")
    assert odd.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in odd.collect()) == [0, 0, 1, 1, 2, 5, 6, 7, 8, 9]
    assert corpus_pipeline.near_dedup(spark, no_docs, "").count() == 0


def brute_recall(found, ids, x, every):
    """Share of the true ten nearest found, and the fewest rows of a query."""
    by_query = found.groupby("query_id").vec_id.agg(set).to_dict()
    hits, asked = [], [i for i in range(len(ids)) if ids[i] % every == 0]
    for i in asked:
        apart = ((x - x[i]) ** 2).sum(axis=1)
        apart[i] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, apart))[:10]]) & by_query.get(ids[i], set())) / 10)
    return np.mean(hits), min(len(by_query.get(ids[i], ())) for i in asked), dict(zip(ids[asked], hits, strict=True))


def test_vectors_alone_in_their_cells(spark):
    rng = np.random.default_rng(6)
    axis = rng.normal(size=24)
    axis /= np.linalg.norm(axis)
    x = np.concatenate([4 * axis + 0.3 * rng.normal(size=(6000, 24)), [-4 * axis], -6 * axis + 0.01 * rng.normal(size=(5, 24))]).astype("f4").astype(float)
    ids = np.arange(len(x))
    table = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "vec_id long, embedding array<float>").repartition(4)
    found = neighbours.nearest(table, every=100).toPandas()
    recall, fewest, hits = brute_recall(found, ids, x, 100)
    assert fewest == 10 and recall >= 0.9
    assert {6001, 6002, 6003, 6004, 6005} <= set(found[found.query_id == 6000].vec_id)
    again = neighbours.nearest(table.filter("vec_id < 6001 or vec_id > 6003"), every=6004).toPandas()
    assert set(again.query_id) == {0, 6004} and (again.groupby("query_id").size() == 10).all()
    assert {6000, 6005} <= set(again[again.query_id == 6004].vec_id)


def test_alias_targets_of_every_form(spark):
    base = "http://a.com/d/e/page.html?x=1#top"
    canonical, refresh = "<link rel=canonical href={}>", '<meta http-equiv="refresh" content={}>'
    forms = [
        (canonical.format('"other.html"'), "a.com/d/e/other.html"),
        (canonical.format('"?page=1"'), "a.com/d/e/page.html?page=1"),
        (canonical.format("'../x'"), "a.com/d/x"),
        (canonical.format('"../../../x/./y/.."'), "a.com/x/"),
        (canonical.format("/login?next=http://b.com"), "a.com/login?next=http://b.com"),
        (canonical.format("login?next=http://b.com"), "a.com/d/e/login?next=http://b.com"),
        (canonical.format('"http://c.com/?a=1&amp;b=2"'), "c.com/?a=1&b=2"),
        (canonical.format('" //C.com/q "'), "c.com/q"),
        (canonical.format('"mailto:x@b.com"'), None),
        (canonical.format('"#part"'), "a.com/d/e/page.html?x=1"),
        (refresh.format("\"0; url='http://c.com/r'\""), "c.com/r"),
        (refresh.format("'0;URL=\"r.html?a=1&amp;b=2\"'"), "a.com/d/e/r.html?a=1&b=2"),
        (refresh.format('"0; url=&#39;http://c.com/s&#39;"'), "c.com/s"),
        (refresh.format("0;url=/t"), "a.com/t"),
        (refresh.format('"30"'), None),
    ]
    pages = spark.createDataFrame([(base, html) for html, _ in forms], "url string, html string")
    found = [r["target"] for r in urlrules.alias_links(pages).collect()]
    assert sorted(filter(None, found)) == sorted(filter(None, [want for _, want in forms]))
    more = [
        ("<script>var a = '<link rel=canonical href=/no>';</script><!-- <link rel=canonical href=/no> -->", []),
        ("<!-- open <link rel=canonical href=/no>", []),
        ('<a title="<link rel=canonical href=/no>">x</a><LINK REL="canonical" HREF="/a">', ["http://a.com/a"]),
        ('<base href="/b/"><link rel="alternate canonical" href="x"><link rel=canonical href=y><link rel=nocanonical href=z>', ["http://a.com/b/x", "http://a.com/b/y"]),
        ('<base target=x><base href="http://c.com/q"><base href="/no/"><meta content="1; url=w" http-equiv=Refresh>', ["http://c.com/w"]),
        ("<script>no end <link rel=canonical href=/no>", []),
        ("<style></style><link/rel='canonical'/href=/slash>", ["http://a.com/slash"]),
        ("<link rel=canonical", []),
        (None, []),
    ]
    for html, want in more:
        assert urlrules.alias_targets(base, html) == want, html
    started = time.time()
    for part in ("<link rel=\"", "<!--", "<script ", "<a b='", "<"):
        urlrules.alias_targets(base, part * 200_000)
    assert time.time() - started < 20
    lone = spark.createDataFrame([("a.com/no/scheme", canonical.format("x")), (None, canonical.format("x")), ("http://a.com", canonical.format("x"))], "url string, html string")
    assert [r["target"] for r in urlrules.alias_links(lone).collect() if r["target"]] == ["a.com/x"]
    rows = [
        (1, "http://one.com/a/", '<link rel=canonical href="page.html">'),
        (2, "http://one.com/a/page.html", "<meta http-equiv=refresh content=\"0; url='http://two.net/?a=1&amp;b=2'\">"),
        (3, "http://three.com/", "<link rel=canonical href='/login?next=http://two.net'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urlrules.judge(pages).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_fragments_with_line_breaks(spark):
    ends = ["\n", "\r", "\u0085", "\u2028", "\u2029"]
    pages = spark.createDataFrame([(k, f"http://a.com/x#f{e}b/y?z") for k, e in enumerate(ends)], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    assert {(r["host"], r["path"]) for r in urlrules.judge(pages).collect()} == {("a.com", "/x")}


def test_verdicts_over_a_generated_link_graph(spark):
    """Closure by repeated passes over the links of 2,000 pages."""
    rng = np.random.default_rng(7)
    hosts = ["a.com", "b.org", "c.net", "www.example.net", "example.com", "d.org"]
    paths = ["/", "/en/x", "/de/y", "/fr/z", "/q"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}?{k}" for k in range(2000)]
    links = {}
    for k in range(2000):
        if rng.random() < 0.6:
            links[k] = [int(v) for v in rng.integers(max(0, k - 40), min(2000, k + 40), rng.integers(1, 3))]
    forms = ['<link rel=canonical href="{}">', '<meta http-equiv=refresh content="0; url={}">']
    rows = [(k, urls[k], "".join(forms[(k + i) % 2].format(urls[v]) for i, v in enumerate(links.get(k, [])))) for k in range(2000)]

    def rule(url):
        host, _, path = url.partition("://")[2].partition("?")[0].partition("/")
        fits = [(len(h + p), say) for say, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    group = list(range(2000))
    moved = True
    while moved:
        moved = False
        for k, targets in links.items():
            for v in targets:
                low = min(group[k], group[v])
                moved |= group[k] != low or group[v] != low
                group[k] = group[v] = low
    said = {}
    for k in range(2000):
        said.setdefault(group[k], set()).add(rule(urls[k]))
    want = {k: rule(urls[k]) or ("allow" if "allow" in said[group[k]] else "block" if "block" in said[group[k]] else "allow") for k in range(2000)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    found = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages).collect()}
    assert found == want and sum(v == "block" for k, v in want.items() if rule(urls[k]) is None) > 20


def test_main_text_in_wrappers_with_marks_in_their_names(spark):
    costs = mainpage.costs_of({})
    words = "<p>Many words in a long paragraph of a page that has something to say.</p>" * 5
    for name in ("post no-sidebar", "post has-sidebar", "content-with-sidebar", "page-banner-layout", "related-work"):
        for body in ('<div class="{}"><h1>It</h1>{}</div>', '<article><div class="{}"><h1>It</h1>{}</div></article>'):
            text = mainpage.extract(PAGE.format(body.format(name, words)), costs)
            assert text.startswith("It\nMany words") and text.count("\n") == 5 and "comment" not in text, name
    head = '<article><div class="article-header"><h1>Title of it</h1></div>{}<div class="share-buttons">Share this</div></article>'
    assert mainpage.extract(PAGE.format(head.format(words)), costs).split("\n")[0] == "Title of it"
    assert "Share" not in mainpage.extract(PAGE.format(head.format(words)), costs)
    side = '<div class="page">{}</div><div class="left-sidebar">Some other things here</div><div class="site-footer">us</div>'
    assert "other things" not in mainpage.extract(PAGE.format(side.format(words)), costs)


def test_main_text_keeps_tables_and_lists(spark):
    costs = mainpage.costs_of({})
    words = "<p>Many words in a long paragraph of a page that has something to say.</p>" * 3
    table = "<table>" + "".join(f"<tr><td>a{k}</td><td>b{k}</td></tr>" for k in range(60)) + "</table>"
    items = "<ul>" + "".join(f"<li>c{k}</li>" for k in range(60)) + "</ul>"
    for body in ("<article><h1>It</h1>{}</article>", '<div id="content"><h1>It</h1>{}</div>', "<h1>It</h1>{}"):
        for inside in (words + table, words + items, words + table + words, table + words):
            text = mainpage.extract(PAGE.format(body.format(inside)), costs)
            assert text.startswith("It\n") and "comment" not in text and "Read more" not in text
            for k in range(60):
                assert f"a{k} b{k}" in text or f"\nc{k}" in text, (body, k)
            assert text.count("Many words") == inside.count("Many words")


def test_stages_keep_columns_of_any_name(spark, odd_docs):
    """A user's columns named like the stages' own come back as they were."""
    names = ["_spans", "_more", "_all", "_runs", "_name", "_tie", "_text", "_placed", "_parts", "_whole", "row", "tie", "key", "spans", "masked", "mixed", "kept", "component_id", "start"]
    docs = odd_docs.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce("doc_id", F.lit(0))).alias(n) for n in names])
    stages = [quality.kept_documents, simhash.one_per_group, secrets.redacted, mixing.mixed_documents]
    for stage in stages:
        found = stage(docs)
        assert found.columns == docs.columns
        rows = found.collect()
        assert rows or stage is quality.kept_documents
        for r in rows:
            assert [r[n] for n in names] == [f"{n} {r['doc_id'] or 0}" for n in names], stage.__name__
    assert simhash.near_groups(docs).count() == tokenfile.read_shards(tokenfile.write_shards(docs, VOCABULARY)).count() == 12
    assert bpe.encode_decode(docs, VOCABULARY).count() == lm.score(docs).count() == quality.judge(docs).count() == 12
