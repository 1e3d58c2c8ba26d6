"""Chat formatting, runs and the source audit beside plain repetitions, and on odd rows."""

import hashlib
import random
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from riskloom.llm import chat, divergence, periodic  # noqa: E402
from riskloom.llm.queries import HOSTILE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, turns string, merged long"


def read_back(formatted):
    row = formatted.select(
        "*",
        chat.read_turns(F.col("formatted")).alias("back"),
        chat.learned_texts(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    return {r["conv_id"]: r for r in row.collect()}


def test_chats_of_odd_rows(spark):
    marks = [chat.OPEN, chat.SAYS, chat.NEXT, chat.CLOSE + chat.GAP, chat.CLOSE, r"<\turn>", r"<\\\says>", "<", "<turn", "\\", "$1", HOSTILE, ""]
    rng = random.Random(2)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two"), (1, 2, "assistant", "two"), (1, 3, "user", None), (1, None, "system", "first")]
    rows += [(2, 0, None, None), (None, 0, "user", "no key"), (None, 1, "assistant", "é漢字👍"), (3, 5, "assistant", ""), (4, 0, "<turn>\n<says>", "x")]
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(marks, k=rng.randrange(6)))))
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], TURNS)
    found = read_back(chat.format_chats(table))
    assert set(found) == {r[0] for r in rows}
    for key, r in found.items():
        want = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == key)
        assert [(b["role"], b["text"]) for b in r["back"]] == [w[1:] for w in want]
        assert r["learned"] == [w[2] for w in want if w[1] == "assistant"]
        assert sum(s["skip"] + s["chars"] for s in r["loss"]) + len(chat.CLOSE + chat.GAP) == len(r["formatted"])
        assert r["formatted"].count(chat.CLOSE + chat.GAP) == sum(a != b for a, b in zip([None] + [w[1] for w in want], [w[1] for w in want]))
    assert found[1]["formatted"].endswith("<turn>assistant<says>one<next>two<next>two</turn>\n<turn>user<says></turn>\n")
    assert chat.format_chats(table.limit(0)).count() == 0


def test_mask_that_does_not_fit_is_refused(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "abc", None, None)], TURNS)
    wrong = chat.format_chats(table).withColumn("formatted", F.lit("<turn>assistant<says>abcd</turn>\n"))
    assert read_back(wrong)[1]["learned"] is None


def test_long_conversation_takes_time_in_proportion(spark):
    def spent(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("<turn> word "), 20).alias("text"))
        started = time.time()
        r = read_back(chat.format_chats(rows))[1]
        assert len(r["back"]) == n and len(r["learned"]) == n - (n + 2) // 3
        return time.time() - started

    spent(1000)
    assert spent(40_000) < 30


def test_chat_query(spark):
    found = {r["conv_id"]: r for r in QUERIES["op12_chat_formatting"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    told = {}
    for r in sorted(rows, key=lambda r: r["turn"]):
        told.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    told[-7] = [("user", HOSTILE), ("assistant", HOSTILE)]
    assert set(found) == set(told)
    for key, turns in told.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = found[key]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            words = brute.planted(rng.randrange(1000), words)
        least = rng.choice([2, 3, 4, 7, 12])
        got = sorted((a, b - a, q) for (a, q), b in periodic.runs(words, least).items())
        assert got == brute.word_runs(words, least), (words, least)


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    texts = []
    for k in range(300):
        base = [b"w%d" % rng.randrange(40) for _ in range(rng.randrange(120))]
        part = base[: rng.randrange(1, 30)] * rng.randrange(1, 5)
        texts.append(base + part + [b"w%d" % rng.randrange(3) for _ in range(rng.randrange(40))] + part * (k % 3))
    assert periodic.find_runs(texts) == [brute.word_runs(t) for t in texts]


def test_long_run_texts_take_time_in_proportion():
    fibonacci, after = [0], [0, 1]
    while len(after) < 60_000:
        fibonacci, after = after, after + fibonacci
    rng = random.Random(3)
    for words in (after, [0] * 60_000, [k % 777 for k in range(60_000)], [rng.randrange(2) for _ in range(60_000)]):
        started = time.time()
        periodic.runs(words)
        assert time.time() - started < 20


def test_runs_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars < 12000 or n_chars is null").collect()
    some = 0
    for d in docs:
        words = brute.planted(d["doc_id"], brute.words(d["text"]))
        want, r = brute.word_runs(words), found[d["doc_id"]]
        some += len(want)
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        best = min(want, key=lambda w: (-w[1], w[0], w[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert some > 10


def test_runs_on_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    found = periodic.periodic_runs(docs).collect()
    assert len(found) == 12
    own = {r["doc_id"]: r for r in found if r["doc_id"]}
    assert own[2]["runs"] == [] and own[3]["collapsed"] == "" and own[4]["n_words"] == 0
    assert [tuple(r) for r in own[1]["runs"]] == [(0, 180, 6)]
    assert own[1]["collapsed"] == "the of and token = abcdef12345"
    assert periodic.periodic_runs(no_docs).count() == 0


def test_audit_of_small_groups(spark, odd_docs, no_docs):
    rng = random.Random(8)
    words = ["the", "THE", "of", "naïve", "x1y", "漢字", "it's", "", "Ünter", "a"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "z"]), 1) for k in range(400)]
    rows += [(k, "copied text of the many", "en", rng.choice("ab"), 1) for k in range(300)]
    rows += [(None, None, "only", None, None), (1, "rare", "lone", "one", 1), (1, "rare", "lone", "two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").withColumn("term", F.lit(1)).repartition(7)
    for least, terms in ((30, 50), (5, 3)):
        got = sorted(tuple(r) for r in divergence.audit(docs, least=least, terms=terms).collect())
        assert got == brute.divergence([r.asDict() for r in docs.collect()], least, terms)
    odd = sorted(tuple(r) for r in divergence.audit(odd_docs, least=1).collect())
    assert odd == brute.divergence([r.asDict() for r in odd_docs.collect()], 1, 50)
    assert divergence.audit(no_docs).count() == 0
