"""Each operator against a brute-force version, and on the odd cases."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arrayloom.llm import chat, decontaminate, language, lines, neardup, pack, queries, shard, substrings, topk, toxicity
from arrayloom.llm._common import sample
from arrayloom.llm._words import mix
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, id long"
WORDS = [f"w{k}" for k in range(400)]


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empties, ties, one long text, clashing columns."""
    base, passage = words(1, 300), words(2, 70)
    near = base[:150] + ["changed"] + base[151:]
    texts = [" ".join(base), " ".join(near), " ".join(base), " ".join(words(3, 80) + passage), " ".join(words(4, 60) + passage + words(5, 30)), None, "", "  \n ", "short one", "short one", " ".join(words(6, 30_000)), "a\nb\nc\nd\ne", "x\na\nb\nc\ny", "\n\n\n\n\n", "q\na\nb\nc\nd"]
    rows = [(i, t, "en", "h", len(t or ""), 7, 8) for i, t in enumerate(texts)]
    rows += [(None, "nobody's text", None, None, None, None, None), rows[8]]
    return spark.createDataFrame(rows, SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 0 and got[9] == 8 and got[None] is None
    assert all(got[k] == k for k in (3, 4, 5, 6, 7, 10, 11, 12, 13, 14))
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.drop_near_duplicates(docs).count() == docs.count() - 3


def test_near_duplicates_brute_force(spark):
    rng, texts = random.Random(5), []
    for g in range(12):
        base = words(100 + g, 120)
        for _ in range(8):
            texts.append(" ".join(w if rng.random() > 0.012 else rng.choice(WORDS) for w in base))
    sets = [Counter(tuple(t.split()[j : j + 5]) for j in range(116)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = sum((sets[a] & sets[b]).values())
        if both >= 0.8 * (232 - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame).collect()} == {i: find(i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_keys_and_other_writing(spark):
    base = words(1, 80)
    rows = [(3, " ".join(base)), (1, " ".join(w.upper() + "," for w in base)), (7, "\n".join(base) + " ***"), (9, " ".join(words(2, 80))), (9, " ".join(base)), (9, " ".join(base)), (12, " ".join(words(2, 80))), (13, "!!! ..."), (14, "!!! ...")]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep int, n int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 1), (7, 1), (9, 1), (9, 1), (9, 1), (12, 1), (13, 13), (14, 14)]


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, 50, dtype=np.uint64)
    a, b = rng.uniform(0.2, 3, 50), rng.uniform(0.2, 3, 50)
    marks = neardup.signatures(np.repeat([0, 1], 50), np.concatenate([e, e]), np.concatenate([a, b]), 2, 4000)
    assert (marks[0] == marks[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def removed(rows, length=50):
    """(kept words, removed) of each (key, text), by definition."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = {}
    for i, w in split:
        for j in range(len(w) - length + 1):
            seen[tuple(w[j : j + length])] = min(i, seen.get(tuple(w[j : j + length]), i))
    out = []
    for i, w in split:
        gone = {k for j in range(len(w) - length + 1) if seen[tuple(w[j : j + length])] < i for k in range(j, j + length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substrings(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    got = substrings.dedup_substrings(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got if r["doc_id"] is not None) == removed(rows)
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest() for r in got)
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_substrings_of_repeated_keys(spark):
    """One key with several texts, long before and short after, and a row twice."""
    passage = words(2, 60)
    rows = [(1, " ".join(passage)), (2, " ".join(words(3, 200) + passage)), (2, "tiny text here"), (2, " ".join(passage + words(4, 90))), (2, " ".join(passage + words(4, 90))), (2, None), (3, " ".join(words(4, 90)))]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == removed(rows)


@pytest.mark.parametrize("length", [1, 7, 16, 50])
def test_substrings_at_all_lengths(spark, length):
    rng, passages = random.Random(length), [words(200 + k, length + 3 * k) for k in range(6)]
    rows = [(i // 2, " ".join(sum(([*words(i * 9 + k, rng.randint(0, 20)), *rng.choice(passages)] for k in range(4)), []))) for i in range(60)]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == removed(rows, length)
    assert all(b <= 2 * a for a, b in itertools.pairwise([*substrings.levels(length), length]))


def test_lines(spark, docs):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[12]["text"] == "x\ny" and got[14]["text"] == "q" and got[11]["n_removed"] == 0
    assert got[13]["n_removed"] == 0 and got[5]["text"] is None and got[5]["n_lines"] == 0 and got[6]["text"] == ""
    assert lines.dedup_lines(docs).count() == docs.count() and lines.dedup_lines(empty(spark)).count() == 0
    assert set(docs.columns) < set(lines.dedup_lines(docs).columns)
    clash = docs.withColumnsRenamed({"hash": "_id", "id": "_row", "source": "n_lines"})
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(clash).collect()} == {k: r["text"] for k, r in got.items()}


def test_lines_of_a_long_text(spark):
    text = "\n".join(f"line {k}" for k in range(200_000))
    start = time.monotonic()
    got = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nmore")], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["text"] == text
    assert got[2]["n_lines"] == 200_001 and got[2]["text"] == "more"
    assert time.monotonic() - start < 60


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(words(2, 70)[5:40]).upper()), (2, "Short ONE!"), (3, None), (4, ""), (None, "x"), (5, "short one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, bench).collect()}
    assert got[3]["n_hit"] == got[4]["n_hit"] == 35 and got[4]["item_ids"] == ["1"]
    assert got[8]["item_ids"] == ["2", "5"] and got[8]["spans"][0].asDict() == {"first": 0, "end": 9}
    assert got[5]["n_words"] == 0 and got[10]["n_hit"] == 0
    with pytest.raises(ValueError):  # what is broadcast is bounded, and nothing is left out in silence
        decontaminate.scan(docs, bench, most_bytes=60)
    clash = docs.withColumnsRenamed({"hash": "spans", "id": "n_hit"})
    again = {r["doc_id"]: r["n_hit"] for r in decontaminate.scan(clash, bench).collect()}
    assert again == {k: r["n_hit"] for k, r in got.items()} and decontaminate.scan(empty(spark), bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def jump_one(key, shards):
    """Jump consistent hashing of one key, step by step."""
    state = int(mix(np.array([(key + 0x9E3779B97F4A7C15) % 2**64], dtype=np.uint64))[0])
    at, ahead = 0, 0
    while ahead < shards:
        at = ahead
        state = (state * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (2.0**31 / ((state >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 1000])
def test_jump_hash_against_one_key_at_a_time(shards):
    keys = np.array([0, 1, 2, 7, 10**12, 2**63, 2**64 - 1, *range(100, 3000)], dtype=np.uint64)
    assert shard.jump(keys, shards).tolist() == [jump_one(int(k), shards) for k in keys]


def test_shards(spark, docs):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = shard.assign(frame).collect()
    assert all(r["shard"] == jump_one(r["doc_id"], 16) and r["grown_shard"] == jump_one(r["doc_id"], 17) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert 200 < sum(r["grown_shard"] == 16 for r in rows) < 400
    for s in range(16):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s)
        assert own == list(enumerate(sorted(r["doc_id"] for r in rows if r["shard"] == s)))
    assert all(r["text_crc32"] == zlib.crc32(str(r["doc_id"]).encode()) and r["size"] == len(str(r["doc_id"])) + 1 for r in rows)
    odd = {r["doc_id"]: r for r in shard.assign(docs.withColumnRenamed("hash", "size")).collect()}
    assert odd[5]["size"] == 1 and odd[5]["text_crc32"] == 0 and None in odd and shard.assign(empty(spark)).count() == 0


def test_ranks_in_blocks(spark):
    from arrayloom.llm._common import ranked

    frame = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 3).alias("g"))
    rows = ranked(frame, "g", "k", "r", [], block_rows=100).collect()
    for g in range(3):
        own = sorted((r["k"], r["r"]) for r in rows if r["g"] == g)
        assert [r for _, r in own] == list(range(len(own)))
    tied = ranked(frame.withColumn("k", F.lit(1)), "g", "k", "r", [], block_rows=100)  # ties do not stay in one block
    assert sorted((r["g"], r["r"]) for r in tied.collect()) == [(g, r) for g in range(3) for r in range(1000)]


def test_joins_of_hot_keys(spark, monkeypatch):
    from arrayloom.llm import _common

    monkeypatch.setattr(_common, "NEAR_ROWS", 2)
    monkeypatch.setattr(_common, "HOT", 10)
    left = _common.cut(spark.range(1000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).cast("long").alias("k"), "id"))
    right = _common.cut(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 60"))
    plain = lambda df: sorted(map(tuple, df.select("k", "id", "n").collect()), key=repr)
    for how in ("inner", "left"):
        assert plain(_common.hot_join(left, right, ["k"], "n", how)) == plain(left.join(right, "k", how))
    hot = _common.hot_keys(left, ["k"], "copies")
    assert [tuple(r) for r in hot.select("k").collect()] == [(0,)]
    assert plain(_common.salted_join(left, right, ["k"], hot, "copies")) == plain(left.join(right, "k"))


def test_topk(spark):
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, float("nan")] * 4), (None, [0.0] * 8), (950, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5, data_block=90, query_block=3)
    ints = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 360, 50):
        order = sorted((-int(ints[q] @ ints[i]), i) for i in range(360) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    one = topk.top_k(frame, frame.where("vec_id % 50 = 0").union(frame.where("vec_id % 50 = 0")), 5)  # one block, and queries twice
    assert sorted(tuple(r) for r in one.collect()) == sorted(want)
    twice = topk.top_k(frame.union(frame).withColumn("cell", F.lit(1)), frame.where("vec_id = 50"), 4, data_block=200, query_block=3).collect()
    assert [r["vec_id"] for r in sorted(twice, key=lambda r: r["rank"])] == [w[2] for w in sorted(want) if w[0] == 50 for _ in range(2)][:4]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_packing(spark, docs):
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        best = min(pack.padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert pack.padding(lengths, counts, pack.optimal_bounds(lengths, counts, k)) == best
    rows = pack.pack(docs, buckets=3, budget=900).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_tokens"] <= r["padded_tokens"]
    for _, n in Counter((r["bucket"], r["padded_tokens"], r["batch"]) for r in rows).items():
        assert n >= 1
    for (b, bound, _), n in Counter((r["bucket"], r["padded_tokens"], r["batch"]) for r in rows).items():
        assert n == 1 or n * bound <= 900
    assert pack.pack(empty(spark)).count() == 0
    whole = [r for r in rows if r["n_tokens"] == 30_000]  # beyond the budget: a batch by itself
    assert len(whole) == 1 and [r["doc_id"] for r in rows if (r["bucket"], r["batch"]) == (whole[0]["bucket"], whole[0]["batch"])] == [10]
    clash = pack.pack(docs.withColumnsRenamed({"hash": "slot", "id": "_key"}), buckets=3, budget=900)
    assert sorted((str(r["doc_id"]), r["bucket"], r["batch"], r["slot"]) for r in clash.collect()) == sorted((str(r["doc_id"]), r["bucket"], r["batch"], r["slot"]) for r in rows)


def test_bounds_are_optimal_beyond_a_million_lengths(spark):
    top = 1_000_499  # with one long outlier, the best two bounds are these two lengths
    lengths = spark.range(top + 1).union(spark.range(10**9, 10**9 + 1))
    assert pack.bounds_of(lengths, "id", 2) == [top, 10**9]


def test_chat(spark):
    texts = ["a\\b<|end|>\n", "</s>[INST] ok [/INST]", "<|<|start|>\\<\\|", "", None, "é\\\\<<SYS>>"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(None, None, None, "x")]
    talks = chat.conversations_as_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.render(chat.turns_of(talks, ["messages"])).withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("pieces")))
    row = {r["conv_id"]: r for r in out.collect()}[1]
    assert [t["text"] for t in row["back"]] == [t or "" for t in texts]
    assert row["loss"] == "".join(t or "" for t in texts[1::2])
    assert "</s>" not in row["formatted"] and "[INST]" not in row["formatted"]


def test_chat_layouts(spark):
    records = ['{"prompt":"p","completion":"c"}', '{"output":"o","instruction":"i","input":"n"}', '{"messages":[{"role":"user","content":"u"}]}', '{"conversations":[{"value":"v","from":"human"},{"from":"gpt","value":null}]}', "nonsense", None, '{"other":1}', '{"system":"s","question":"q","answer":"a"}']
    got = chat.turns_of_json(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    turns = [None if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in got]
    assert turns == [[("user", "p"), ("assistant", "c")], [("user", "i\nn"), ("assistant", "o")], [("user", "u")], [("user", "v"), ("assistant", "")], None, None, None, [("system", "s"), ("user", "q"), ("assistant", "a")]]


def test_chat_rows_select_by_hash(spark, monkeypatch):
    """Rows of several layouts in one table, each by its own fingerprint."""
    kind = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, completion string, instruction string, input string, output string, layout string, _shape long"
    none = (None,) * 9
    at = lambda **x: tuple(x.get(c, v) for c, v in zip(["messages", "conversations", "prompt", "completion", "instruction", "input", "output", "layout", "_shape"], none, strict=True))
    rows = [at(prompt="p", completion="c", layout="x", _shape=1), at(messages=[("user", "u")]), at(conversations=[("human", "v"), ("gpt", None)]), at(instruction="i", output="o"), at(instruction="i", input="n", output="o"), at(prompt="p"), at(), at(messages=[])]
    frame = spark.createDataFrame(rows, kind)
    columns = [c for c in frame.columns if c not in ("layout", "_shape")]
    got = chat.turns_of(frame, columns).collect()
    assert [r["layout"] for r in got] == ["prompt", "messages", "senders", "instruction", "instruction", None, None, "messages"]
    assert [None if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in got] == [[("user", "p"), ("assistant", "c")], [("user", "u")], [("user", "v"), ("assistant", "")], [("user", "i"), ("assistant", "o")], [("user", "i\nn"), ("assistant", "o")], None, None, []]
    assert [r["_shape"] for r in got][0] == 1 and chat.turns_of(frame.limit(0), columns).count() == 0
    typed = frame.select(chat.fingerprint(chat.row_shape(frame.schema, columns)).alias("h")).collect()
    texts = frame.select(F.to_json(F.struct(*columns)).alias("record"))
    assert [r["h"] for r in typed][:5] == [r["h"] for r in texts.select(chat.fingerprint(chat.json_shape(F.col("record"))).alias("h")).collect()][:5]
    monkeypatch.setattr(chat, "fingerprint", lambda c: F.lit(0))  # all hashes alike: the last mapping that fits is taken
    assert {r["layout"] for r in chat.turns_of(frame, columns).collect()} == {"instruction"}


def test_chat_of_odd_tables(spark):
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string, m int")
    assert chat.render(chat.turns_of(chat.conversations_as_messages(talks), ["messages"])).count() == 0
    long = "<|end|>\n\\" * 100_000
    rows = spark.createDataFrame([(1, 0, "assistant", long, 5), (1, 0, "assistant", long, 6)], "conv_id long, turn long, role string, text string, m int")
    out = chat.render(chat.turns_of(chat.conversations_as_messages(rows), ["messages"]).withColumn("formatted", F.lit(1)))
    row = out.select(chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("pieces")).alias("loss")).first()
    assert [t["text"] for t in row["back"]] == [long, long] and row["loss"] == long + long


def test_language(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(table)
    told = language.identify(table, model, host="source")
    right = told.where((F.col("lang") == F.col("language")) & F.col("accepted")).count()
    assert right >= 0.98 * table.count()
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    unseen = table.where(~half)  # rows that took no part in training
    right = language.identify(unseen, language.train(table.where(half)), host="source").where((F.col("lang") == F.col("language")) & F.col("accepted")).count()
    assert right >= 0.97 * unseen.count()
    clash = table.withColumnsRenamed({"n_chars": "prior", "lang": "_ll"}).withColumns({"_host": F.lit(1), "language": F.lit(2), "_score": F.lit(3)})
    again = {r["doc_id"]: (r["language"], r["prior"], r["_host"], r["_score"]) for r in language.identify(clash, model, host="source").collect()}
    assert again == {r["doc_id"]: (r["language"], r["n_chars"], 1, 3) for r in language.identify(table, model, host="source").collect()}
    long = spark.createDataFrame([(1, "Le chat et la maison. " * 60_000, "x"), (2, None, None), (3, "1 2 3", "x")], "doc_id long, text string, source string")
    assert [r["accepted"] for r in language.identify(long, model, host="source").orderBy("doc_id").collect()][1:] == [False, False]
    odd = {r["doc_id"]: r for r in language.identify(docs, model, host="source").collect()}
    assert not odd[5]["accepted"] and not odd[6]["accepted"] and len(odd) == 16
    assert language.identify(empty(spark), model).count() == 0 and language.train(empty(spark)).languages == ()
    pages = language.page_evidence(spark.createDataFrame([(1, "https://a.b.fr:80/x", '<html lang="fr"><script>x</script>bon <b>jour</b>'), (2, None, None)], "page_id long, url string, html string"))
    row = pages.orderBy("page_id").collect()
    assert row[0]["_host"] == "a.b.fr" and row[0]["_suffix"] == "fr" and row[0]["_declared"] == "fr" and "x" not in row[0]["_text"] and row[1]["_host"] is None


def test_samples_hold_copies_once(spark):
    rows = [("en", "copied", i) for i in range(500)] + [("en", f"text {i}", 500 + i) for i in range(60)] + [(None, "x", 1), ("de", None, 2)]
    df = spark.createDataFrame(rows, "label string, t string, key long")
    got = sample(df, "label", "t", 40, 10).collect()
    english = [r for r in got if r.label == "en"]
    assert len(english) == len({r.t for r in english}) == 40
    assert all(r.key == 0 for r in english if r.t == "copied")
    assert [r for r in got if r.label is None] == []
    assert sample(df.select("label", "t"), "label", "t", 100, 10).where("label = 'en'").count() == 61


def test_toxicity():
    rng = random.Random(2)
    make = lambda bad: " ".join([*(rng.choice(WORDS) + rng.choice(["ab", "ing", "tion"]) for _ in range(40)), *([rng.choice(["grobian", "grobiank", "stinkard"])] if bad else [])])
    labels = np.array([k % 3 == 0 for k in range(240)]).astype(np.int64)
    model = toxicity.fit(pa.array([make(x) for x in labels]), labels)

    def score(text):
        best = model.bias
        owner, _, first, end, symbols = toxicity.windows(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        if len(owner):
            matrix, _ = toxicity.distinct(first, end, symbols)
            best = (toxicity.scores(matrix, model.weights) + model.bias).max()
        return 1 / (1 + np.exp(-(model.slope * best + model.shift)))

    held = [(x, score(make(x))) for x in [0, 1] * 40]
    assert sum((s >= 0.7) == bool(x) for x, s in held) >= 78
    assert score("w1ab g.r.o.b.i.a.n w2ing") >= 0.7 and score("w1ab g r o b i a n w2ing") >= 0.7 and score("groxbian") > 0.5
    assert score("") < 0.5


def naive_features(word):
    """Gapped subsequences of three symbols within SPAN, each occurrence with DECAY to its length."""
    out = Counter()
    for a, b, c in itertools.combinations(range(len(word)), 3):
        if c - a < toxicity.SPAN:
            out[word[a], word[b], word[c]] += toxicity.DECAY ** (c - a + 1)
    return out


def test_toxicity_kernel_map_and_score_by_definition():
    rng = np.random.default_rng(4)
    words_ = [rng.integers(1, 5, n) for n in (3, 5, 8, 9, 13, 14, 15, 20, 24)]
    matrix = np.array([[*w, *[0] * (toxicity.LENGTH - len(w))] for w in words_])
    sparse = [naive_features(w.tolist()) for w in words_]
    norm = toxicity._reach(np.array([len(w) for w in words_]))
    dense = toxicity.features(matrix).astype(float)
    index = lambda t: (t[0] * toxicity.SYMBOLS + t[1]) * toxicity.SYMBOLS + t[2]
    for row, own, size in zip(dense, sparse, norm, strict=True):
        want = np.zeros(toxicity.SYMBOLS**3)
        for t, x in own.items():
            want[index(t)] = x / size
        assert np.allclose(row, want, atol=1e-6)
    kernel = toxicity.scores(matrix, np.ascontiguousarray(dense.T))  # of every pair of windows
    want = [[sum(x * q[t] for t, x in p.items()) / a / b for q, b in zip(sparse, norm, strict=True)] for p, a in zip(sparse, norm, strict=True)]
    assert np.allclose(kernel, want, atol=1e-6)
    # The Nystrom map of landmarks 0 to 4, and a machine in it, fold into weights of subsequences.
    values, vectors = np.linalg.eigh(kernel[:5, :5])
    map_, w = vectors / np.sqrt(values), rng.normal(size=5)
    assert np.allclose((kernel[:, :5] @ map_) @ (kernel[:, :5] @ map_).T @ np.eye(9)[:, :5], kernel[:, :5], atol=1e-5)  # exact on the landmarks
    assert np.allclose(toxicity.scores(matrix, dense[:5].T @ (map_ @ w)), kernel[:, :5] @ map_ @ w)


def test_toxicity_windows():
    text = "Ab cd ef. Gh i.j x\ny z " + "q" * 30
    data = np.frombuffer(text.encode(), np.uint8)
    owner, sentence, first, end, symbols = toxicity.windows(data, np.array([0, len(data)]))
    letters = "".join(chr(96 + c) for c in symbols)
    got = [(int(s) // 2, int(s) % 2, letters[a:b]) for s, a, b in zip(sentence, first, end, strict=True)]
    assert [x[2] for x in got if not x[1]] == ["ab", "cd", "ef", "gh", "ij", "xyz", "q" * 24, "q" * 18]
    assert [x for x in got if x[1]] == [(0, 1, "abcd"), (0, 1, "cdef"), (1, 1, "ghij"), (1, 1, "ijxyz")]


def test_toxicity_of_two_words_each_harmless_alone():
    rng = random.Random(8)
    make = lambda bad: ". ".join([" ".join([*(rng.choice(WORDS) + rng.choice(["ab", "ing"]) for _ in range(8)), *(["rotten egg"] if bad and k == 2 else ["egg", rng.choice(WORDS), "rotten"])]) for k in range(4)])
    labels = np.array([k % 3 == 0 for k in range(300)]).astype(np.int64)
    model = toxicity.fit(pa.array([make(x) for x in labels]), labels)
    scored = []
    for x in [0, 1] * 30:
        data = np.frombuffer(make(x).encode(), np.uint8)
        _, _, first, end, symbols = toxicity.windows(data, np.array([0, len(data)]))
        best = (toxicity.scores(toxicity.distinct(first, end, symbols)[0], model.weights) + model.bias).max()
        scored.append((x, model.slope * best + model.shift > 0))
    assert sum(a == b for a, b in scored) >= 54


def test_toxicity_rows(spark, docs):
    model = toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(empty(spark), model).count() == 0
    clash = toxicity.score(docs.withColumnsRenamed({"hash": "score", "id": "margin"}), model)
    assert clash.where("score between 0 and 1").count() == docs.count() and "margin" in clash.columns


def test_toxicity_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.01").join(table, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.05 * len(clean)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    sql = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        sql.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got, want = queries.queries()[name](spark, SMALL), sql.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    pick = lambda columns, rows: sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())


def test_pipeline(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SMALL)
        assert new.columns == table.columns and 0 < new.count() <= docs.count(), name
        docs = spark.createDataFrame(new.collect(), new.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


KEPT = {"line_dedup": 17, "near_dedup": 14, "decontamination": 17, "packing": 17}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, docs, name, stage):
    """Nulls, empty and long texts, ties, repeated rows, no rows, and names that clash."""
    names = ["language", "n_removed", "_id", "n_hit", "spans", "_key"]
    odd = docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    got = stage(spark, odd, SMALL)
    assert all(c in got.columns for c in odd.columns if c not in ("n_tokens",)) and (name == "packing" or got.columns == odd.columns)
    rows = got.collect()
    assert all([r[c] for c in names] == list(range(6)) for r in rows) and len(rows) == KEPT.get(name, len(rows))
    if name == "language_id":
        assert not {5, 6, 7, 13} & {r["doc_id"] for r in rows} and len(rows) >= 8
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (45, 2)) if p[0] != p[1]})
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
