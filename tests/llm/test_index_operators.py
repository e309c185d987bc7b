"""Collocations, WARC archives and periodic runs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import collocations, periodic_runs, registry, warc
from eventide.llm.common import shared_folder

LONG = " ".join(str(i % 977) for i in range(60_000))
SCHEMA = "key long, text string, lang string, codes string, names string, chunk string, runs string, collapsed string, surt string, sum string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t", LONG, "a b " * 40, "a b " * 40, "x", "A. b, a b! a b? a b\n" * 20, "é ü é ü é ü é ü"]
    rows = [(i, t, None if i == 4 else "en", *("x",) * 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-2], (None, "a b " * 9, None, *("x",) * 7)], SCHEMA)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_warc", "op13_periodic_runs"])
def test_queries_and_sql(spark, sf_dir, same, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


def plain_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((s, e, p) for (s, e), p in out.items())


def test_runs_against_all_periods():
    rng = np.random.default_rng(5)
    for trial in range(1500):
        kinds = int(rng.integers(1, 5))
        words = rng.integers(0, kinds, int(rng.integers(1, 120)))
        if trial % 4:
            parts = []
            for _ in range(rng.integers(1, 6)):
                parts.append(np.tile(rng.integers(0, kinds, rng.integers(1, 8)), rng.integers(1, 9)))
                if trial % 4 > 1:
                    parts = [np.tile(np.concatenate(parts), rng.integers(1, 3))]
            words = np.concatenate(parts)[:300]
            if trial % 4 == 3:
                words = np.concatenate([words, words[::-1], words, [9], words])[:400]
        assert [tuple(r) for r in periodic_runs.runs_of(words.astype(np.int64)).tolist()] == plain_runs(words.tolist())


def test_parts_of_runs():
    """Level ranks, extensions and previous factors against their definitions."""
    rng = np.random.default_rng(7)
    for _ in range(100):
        words = rng.integers(0, 2, int(rng.integers(6, 60))).astype(np.int64)
        n, w = len(words), words.tolist()
        levels = periodic_runs.names(words)
        assert np.argsort(levels[-1]).tolist() == sorted(range(n), key=lambda i: w[i:])
        a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        a, b = a[a != b], b[a != b]
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert periodic_runs.ahead(levels, a, b).tolist() == [common(w[i:], w[j:]) for i, j in zip(a, b, strict=True)]
        assert periodic_runs.behind(levels, a, b).tolist() == [common(w[:i][::-1], w[:j][::-1]) for i, j in zip(a, b, strict=True)]
        length, source = periodic_runs.previous_factors(levels)
        for i in range(n):
            best = max((common(w[i:], w[j:]) for j in range(i)), default=0)
            assert length[i] == (best if best >= periodic_runs.LEAST else 0)
            assert not length[i] or (source[i] < i and common(w[i:], w[source[i] :]) == length[i])


def test_long_runs_are_fast():
    for words in (np.zeros(100_000, np.int64), np.tile(np.arange(1000), 100), np.tile(np.append(np.zeros(50, np.int64), 1), 2000)):
        runs = periodic_runs.runs_of(words)
        assert [0, len(words)] in runs[:, :2].tolist()


def test_runs_of_odd_rows(spark, odd):
    found = periodic_runs.find(odd, "key", "text")
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r["key"]].append(r)
    assert sum(map(len, got.values())) == odd.count()
    for key in (0, 1, 2, 6):
        assert got[key][0]["runs"] == [] and got[key][0]["n_words"] == (1 if key == 6 else 0)
    assert [tuple(x) for x in got[4][0]["runs"]] == [(0, 80, 2)] and got[4][0]["collapsed"] == "a b"
    assert [tuple(x) for x in got[3][0]["runs"]] == [(0, 60_000, 977)] and got[3][0]["collapsed"] == " ".join(map(str, range(977)))
    assert [tuple(x) for x in got[8][0]["runs"]] == [(0, 8, 2)] and got[8][0]["collapsed"] == "é ü"
    assert len(got[7]) == 2 and got[7][0] == got[7][1] and len(got[None]) == 1
    said = {r["key"]: r for r in periodic_runs.described(found, "key").collect()}
    assert said[4]["runs_sha256"] == hashlib.sha256(b"0,80,2\n").hexdigest() and said[4]["exponent_milli"] == 40_000
    assert said[1]["start"] is None and said[1]["runs_sha256"] == said[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.find(odd.limit(0), "key", "text").count() == 0


def test_periodic_tails(spark):
    rows = [(i, " ".join(str(j) for j in range(i % 50))) for i in range(300)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = 0
    for r in docs.select("doc_id", "text", periodic_runs.with_tail(F.col("text"), F.col("doc_id")).alias("new")).collect():
        words = r["text"].split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert r["new"].split() == words
    assert changed > 10


def plain_phrases(texts, least, longest, covered):
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in texts:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    out = collections.defaultdict(list)
    for (lang, ws), a in counts.items():
        if len(ws) < 2 or a < least:
            continue
        longer = (f for (g, x), f in counts.items() if g == lang and len(x) > len(ws) and f >= least and any(x[i : i + len(ws)] == ws for i in range(len(x))))
        if any(100 * f >= covered * a for f in longer):
            continue
        score, _, left, right = min((2000000 * a // (counts[lang, ws[:k]] + counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return {(g, i + 1, p.decode(), -a, left, right, sizes[g], -s) for g, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows))}


def test_phrases_against_all_counts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    marks = [" ", " ", " ", " ", "\t", ". ", "\n", ", "]
    texts = [("en" if i % 3 else None, "".join(f"{'abcdeÉ'[rng.integers(6)]}{marks[rng.integers(8)]}" for _ in range(rng.integers(0, 60)))) for i in range(120)]
    texts += [("und", "A b c d e f. " * 9), ("en", None), ("en", "")]
    docs = spark.createDataFrame(texts, "l string, t string").repartition(3)
    for least, longest, covered in ((3, 4, 80), (5, 3, 50), (2, 2, 80), (4, 5, 100)):
        got = {tuple(r) for r in collocations.mine(docs, "t", "l", least, longest, covered, None).collect()}
        assert got == plain_phrases(texts, least, longest, covered)
    whole = sorted(collocations.mine(docs, "t", "l", 3).collect())
    assert sorted(collocations.mine(docs, "t", "l", 3, best=7).collect()) == [r for r in whole if r["rank"] <= 7]


def test_names_of_pairs_do_not_come_back(spark, monkeypatch):
    """Only words meet their names in a join; with too many words for that, pairs do too, with the same result."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([("en" if i % 2 else "de", " ".join(f"w{j}" for j in rng.zipf(1.5, 80) if j < 50)) for i in range(90)], "lang string, text string").repartition(5)
    joins, own = [], collocations.named
    monkeypatch.setattr(collocations, "named", lambda held, codes, keys, names: joins.append(keys) or own(held, codes, keys, names))
    found = sorted(collocations.mine(docs, "text", "lang", 5).collect())
    assert joins == [["lang", "word"]] and {r["phrase"].count(" ") for r in found} == {1, 2, 3}
    monkeypatch.setattr(collocations, "MOST_WORDS", 3)
    joins.clear()
    assert sorted(collocations.mine(docs, "text", "lang", 5).collect()) == found and joins == [["lang", "word"], ["left", "right"]]
    texts = [(r["lang"], r["text"]) for r in docs.collect()]
    for longest in (6, 7):
        assert {tuple(r) for r in collocations.mine(docs, "text", "lang", 4, longest, 80, None).collect()} == plain_phrases(texts, 4, longest, 80)


def test_phrases_cross_no_chunk(spark):
    """The result does not depend on how texts are put into chunks."""
    docs = spark.createDataFrame([("en", f"one two three four {i % 4}. one two") for i in range(90)], "lang string, text string")
    every = sorted(collocations.mine(docs.coalesce(1), "text", "lang").collect())
    assert every == sorted(collocations.mine(docs.repartition(7), "text", "lang").collect()) and len(every) > 0


def test_sieve_passes_all_frequent_pairs(spark):
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 1 << 40, (2000, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "left long, right long")
    flags = collocations.sieve(df)
    assert collocations.sieved(flags, pairs[:, 0], pairs[:, 1]).all()
    others = rng.integers(0, 1 << 40, (20_000, 2))
    assert collocations.sieved(flags, others[:, 0], others[:, 1]).mean() < 0.01


def test_phrases_of_odd_rows(odd):
    got = {(r["lang"], r["phrase"]): r for r in collocations.mine(odd, "text", "lang").collect()}
    assert got["und", "a b a b"]["a"] == 47 and got["und", "a b a b"]["n"] == 98 and ("und", "a b") not in got
    assert ("en", "a b") in got and collocations.mine(odd.limit(0), "text", "lang").count() == 0
    assert collocations.mine(odd.where("key = 6"), "text", "lang").count() == 0


def test_surt():
    assert warc.surt("https://me:pw@WWW.Example.net:8080/A/b?q=1#f") == "net,example,www:8080)/A/b?q=1"
    assert warc.surt("http://a.org") == "org,a)" and warc.surt("http://a.org?x") == "org,a)?x"
    assert warc.surt(None) == ")" and warc.surt("mailto:x y\n") == ")mailto:x%20y%0A"


@pytest.fixture(scope="module")
def pages(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"http://h{i % 50}.site{i % 7}.net/p?{rng.integers(300)}", f"<p>{i}</p>" * int(rng.integers(0, 300))) for i in range(900)]
    rows += [(1000 + i, "http://hot.net/", "copy " * 400) for i in range(700)]  # one url and one payload of many
    rows += [(2000, None, None), (2001, "", ""), (2002, "x y\né", "é" * 600), (2003, None, "é" * 600), (2004, "http://a.b/", "small"), (2005, "http://a.b/", "small")]
    rows += [rows[3], (None, "http://n.net/", "é" * 600), (None, "http://n.net/", "alone " * 300), (2006, "http://big.net/", LONG * 20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("sum", F.lit(1)).repartition(5)


def test_archives(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 20)
    archive = warc.write(pages, "page_id", "url", "html", shared_folder(spark), shards=6)
    rows = pages.collect()
    assert archive.captures.count() == len(rows) and 1 <= len(archive.shards) <= 6
    got = warc.read(archive, warc.lookup(archive, pages, "url"), payload=True).collect()
    assert len(got) == len(rows)
    best = collections.defaultdict(lambda: -1)
    for r in rows:
        data = (r["html"] or "").encode()
        best[data] = max(best[data], -1 if r["page_id"] is None else r["page_id"])
    want = collections.Counter()
    for r in rows:
        data, key = (r["html"] or "").encode(), r["page_id"]
        again = len(data) >= 1000 and best[data] >= 0 and (key is None or key < best[data])
        want[key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[data] if again else None, None if again else data] += 1
    assert want == collections.Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got)
    asked = spark.createDataFrame([("HTTP://HOT.net/",), ("http://hot.net/#x",), ("http://nowhere.net/",), ("http://h3.site3.net/p?1",), (None,)], "u string")
    keys = {warc.surt(r["u"]) for r in asked.collect()}
    found = warc.lookup(archive, asked, "u").collect()
    assert len(found) == sum(warc.surt(r["url"]) in keys for r in rows) and {r["surt"] for r in found} <= keys
    # Files are such as other readers take: each member is one record.
    system, path = warc.opened(archive.folder)
    one = archive.captures.where("length > 2000").first()
    with system.open_input_file(f"{path}/{one['file']}") as data:
        text = zlib.decompress(data.read_at(one["length"], one["offset"]), 31)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: re") and text.endswith(b"\r\n\r\n")
    warc.remove(spark, archive)


def test_damaged_records_are_told():
    data = warc.record(1, "http://a/", "1970-01-01T00:00:00Z", hashlib.sha1(b"x" * 99).hexdigest(), 99, b"x" * 98 + b"y", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(data)


def test_no_archives(spark, pages):
    archive = warc.write(pages.limit(0), "page_id", "url", "html", shared_folder(spark))
    assert warc.lookup(archive, pages, "url").count() == 0 and archive.shards == []
    assert warc.read(archive, archive.captures).count() == 0
