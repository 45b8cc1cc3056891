"""The whole pipeline against a version in plain Python, stage after stage."""

import itertools
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from arrayloom.llm import language, pack, queries
from tests.conftest import SMALL


def trigram_counts(text):
    """Hashed trigrams of the folded bytes of ``text``."""
    data = bytearray(text.encode())
    for i, b in enumerate(data):
        if i and 0x80 <= b <= 0x9E and b != 0x97 and text.encode()[i - 1] == 0xC3:
            data[i] = b + 32
        elif 0x41 <= b <= 0x5A:
            data[i] = b + 32
        elif b < 128 and not chr(b).isalpha():
            data[i] = 0x20
    out = Counter()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if not (b == 0x20 and (a == 0x20 or c == 0x20)):
            out[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16] += 1
    return out


def judge(rows, model):
    """(language, posterior) of rows with text, host, declared and suffix, by Bayes' rule."""
    names, n, strength = model.languages, len(model.languages), language.STRENGTH
    likely, votes = [], []
    for r in rows:
        counts = trigram_counts(r["text"] or "")
        own = [language.TEMPER * sum(k * float(t[b]) for b, k in counts.items()) for t in model.table]
        likely.append(own)
        at = own.index(max(own))
        votes.append(at if at < n and re.search(r"[^\W\d_]", r["text"] or "") else None)

    def counted(of):
        out = defaultdict(lambda: [0.0] * n)
        for r, vote in zip(rows, votes, strict=True):
            if of(r) is not None:
                out[of(r)][vote or 0] += vote is not None
        return out

    domain = lambda r: None if r["host"] is None else ".".join(r["host"].split(".")[-2:])
    levels = [(f, counted(f)) for f in (lambda r: None if r["host"] is None else "", domain, lambda r: r["host"])]
    voting = [(r, v) for r, v in zip(rows, votes, strict=True) if v is not None]
    out = []
    for r, own, vote in zip(rows, likely, votes, strict=True):
        mine = [float(k == vote) for k in range(n)]
        prior = [1.0 / n] * n
        if r["host"] is not None:
            for of, table in levels:
                less = [x - y for x, y in zip(table[of(r)], mine, strict=True)]
                prior = [(x + strength * p) / (sum(less) + strength) for x, p in zip(less, prior, strict=True)]
        score = [x + math.log(p) for x, p in zip(own, [*(p * (1 - language.NONE) for p in prior), language.NONE], strict=True)]
        for name, trust in (("suffix", None), ("declared", language.TRUST)):
            value = r[name]
            if value is not None:
                of = [x[name] for x, _ in voting]
                kinds = max(1, len({x for x in of if x is not None}))
                for k in range(n):
                    base = 1 / kinds if trust is None else trust if value == names[k] else (1 - trust) / kinds
                    both = sum(x[name] == value and v == k for x, v in voting) - mine[k]
                    all_ = sum(x[name] is not None and v == k for x, v in voting) - mine[k]
                    score[k] += math.log((both + strength * base) / (all_ + strength))
                score[n] += math.log(1 / kinds)
        best = max(score)
        sure = 1 / sum(math.exp(x - best) for x in score)
        accepted = score.index(best) < n and sure >= language.LEAST and re.search(r"[^\W\d_]", r["text"] or "") is not None
        out.append((names[score.index(best)] if accepted else language.UNKNOWN, sure))
    return out


def told(rows, model):
    """The rows whose language is told from text and source."""
    known = judge([{"text": r["text"], "host": r["source"], "declared": None, "suffix": None} for r in rows], model)
    return [r for r, (name, _) in zip(rows, known, strict=True) if name != language.UNKNOWN]


def test_language_of_documents_and_pages_against_plain_python(spark):
    """All four kinds of evidence: pages bring markup, suffix and hosts."""
    documents, pages = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = [{"key": r["doc_id"], "text": r["text"], "host": r["source"], "declared": None, "suffix": None} for r in documents.collect()]
    rows += [{"key": -1 - r["page_id"], "text": r["_text"], "host": r["_host"], "declared": r["_declared"], "suffix": r["_suffix"]} for r in language.page_evidence(pages).collect()]
    assert len({r["suffix"] for r in rows}) > 2 and len({r["declared"] for r in rows}) > 2
    want = dict(zip([r["key"] for r in rows], judge(rows, language.train(documents)), strict=True))
    got = {r["doc_id"]: (r["language"], r["posterior"]) for r in queries.op1_language_id(spark, SMALL).collect()}
    assert set(got) == set(want)
    for key, (name, sure) in want.items():
        assert got[key][0] == name and abs(got[key][1] - sure) < 2e-6, key


def without_repeated_lines(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        split, gone = r["text"].split("\n"), set()
        for i in range(len(split) - 2):
            window = tuple(split[i : i + 3])
            if any(x.strip(" ") for x in window):
                if window in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(window)
        text = "\n".join(x for i, x in enumerate(split) if i not in gone)
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def one_of_each_class(rows):
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    size = {k: sum(s.values()) for k, s in sets.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if size[a] and size[b] and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]):
            both = sum(min(k, sets[b][e]) for e, k in sets[a].items())
            if both >= 0.8 * (size[a] + size[b] - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def without_benchmark(rows, items):
    def words(text):
        folded = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)

    windows = defaultdict(set)
    for item in items:
        w = words(item["text"])
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[min(len(w), 10)].add(tuple(w[i : i + 10]))
    out = []
    for r in rows:
        w = words(r["text"])
        if not any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1)):
            out.append(r)
    return out


def least_padding(lengths, buckets):
    """The least padding of ``lengths`` in at most so many buckets, by trying all splits."""
    counts = sorted(Counter(lengths).items())
    best = [0, *[math.inf] * len(counts)]
    for _ in range(buckets):
        new = list(best)
        for j in range(1, len(counts) + 1):
            cost = 0
            for i in range(j - 1, -1, -1):
                cost += counts[i][1] * (counts[j - 1][0] - counts[i][0])
                new[j] = min(new[j], best[i] + cost)
        best = new
    return best[-1]


def test_pipeline_against_plain_python(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in documents.collect()]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    kept = [len(rows)]
    rows = told(rows, language.train(documents))
    for stage in (without_repeated_lines, one_of_each_class, lambda r: without_benchmark(r, items)):
        kept.append(len(rows))
        rows = stage(rows)
    assert kept[2] > kept[3] > len(rows) > 0.5 * kept[0]  # the table holds cases for these stages
    original = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert any(r["text"] != original[r["doc_id"]] for r in rows)

    got = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {k: {c: r[c] for c in documents.columns} for k, r in got.items()} == {r["doc_id"]: r for r in rows}

    buckets = defaultdict(list)
    for k, r in sorted(got.items()):
        assert r["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) <= r["padded_tokens"]
        buckets[r["bucket"], r["padded_tokens"]].append(r)
    assert len(buckets) == len({b for b, _ in buckets}) <= pack.BUCKETS
    for (_, bound), held in buckets.items():
        room = max(1, pack.BUDGET // max(1, bound))
        assert [(r["batch"], r["slot"]) for r in held] == [divmod(i, room) for i in range(len(held))]
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in got.values()) == least_padding([r["n_tokens"] for r in got.values()], pack.BUCKETS)
