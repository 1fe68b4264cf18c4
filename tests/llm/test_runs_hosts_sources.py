"""Periodic runs, host verdicts and the audit of sources against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from netstate.llm import host_reputation, periodic_runs, queries, source_audit


def slow_runs(words):
    """Runs by their definition: every stretch of every lag that no smaller one covers."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and not any(
                    s <= i and s + n >= j + q for s, n, _ in found):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcde"), min_size=1, max_size=9),
                          st.integers(1, 20)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    words = [w.encode() for block, times in blocks for w in block * times]
    assert periodic_runs.runs_of(words) == slow_runs(words)


def test_runs_of_long_texts():
    rng = random.Random(2)
    for base in (["a"], ["a", "b"], [str(i) for i in range(400)]):
        words = [rng.choice(base).encode() for _ in range(1500)]
        words[300:1200] = (words[:70] * 20)[:900]
        words[600] = b"break"
        assert periodic_runs.runs_of(words) == slow_runs(words)
    # One word over and over is one run and costs no scan for each lag.
    assert periodic_runs.runs_of([b"x"] * 60_000) == [(0, 60_000, 1)]
    assert periodic_runs.segments(np.arange(50_000) % 20_000) == []


def test_run_queries(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab cd\tefg h \n  i".split(" ")) for _ in range(
        rng.randrange(0, 160)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, " \n\t "), (703, "long " * 3000), (None, "x " * 30),
             (7, rows[7][1]), (7, rows[8][1]), (704, "é\u00a0é ü " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = queries.frequency_split_runs(spark, str(tmp_path)).collect()
    want = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((doc, len(runs), *(best or (None,) * 3),
                     best and 1000 * best[1] // best[2], hashlib.sha256("".join(
                         f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(w for i, w in enumerate(
                         words) if i not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 15


def test_runs_keep_other_columns(spark):
    rows = [(1, "a b " * 20, "kept", 3), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string, best int")
    got = periodic_runs.find_runs(docs, into="runs").collect()
    assert [tuple(r)[:4] for r in got] == rows and got[0].runs.collapsed == "a b"
    assert [tuple(r) for r in got[0].runs.runs] == [(0, 40, 2)] and got[1].runs.runs == []
    replaced = periodic_runs.find_runs(docs)
    assert replaced.columns == ["doc_id", "text", "best", "periodic"]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    assert periodic_runs.plant_repeats(docs.limit(0)).columns == docs.columns


RULES = [("allow", "org", "/"), ("block", "bad.example.org", "/x"), ("block", "com", "/de/")]


def test_rules(spark):
    cases = {
        "http://a.example.org/1": ("a.example.org", "/1", "org/", "allow"),
        "http://BAD.Example.ORG/x?y": ("bad.example.org", "/x", "bad.example.org/x", "block"),
        "http://m.bad.example.org/xy#z": ("m.bad.example.org", "/xy", "bad.example.org/x", "block"),
        "http://sobad.example.org/x": ("sobad.example.org", "/x", "org/", "allow"),
        "https://org": ("org", "", None, None), "https://org/": ("org", "/", "org/", "allow"),
        "http://b.com?q=/de/": ("b.com", "", None, None),
        "http://b.com/de/#/x": ("b.com", "/de/", "com/de/", "block"),
        "x://y://z.com/de/": ("y:", "//z.com/de/", None, None),
        "ftp:/nothing": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "http://é.com/de/ü\n": ("é.com", "/de/ü\n", "com/de/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(cases)],
                                  "page_id long, url string, host string, __n int")
    got = host_reputation.judge(pages, RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == [c[:3] for c in cases.values()]
    for r, case in zip(got, cases.values(), strict=True):
        assert r.verdict == (case[3] or r.verdict) and r.verdict in ("allow", "block")
    assert host_reputation.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages, []).collect()} == {"allow"}


def slow_lower_bounds(outcomes):
    """Posterior bounds of hosts from (host, bad) pairs, level by level."""
    level = {}
    for host, bad in outcomes:
        n, k = level.get(host, (0, 0))
        level[host] = (n + (bad is not None), k + (bad or 0))
    cut = {"host": lambda h: h, "domain": lambda h: ".".join(h.split(".")[-2:]),
           "suffix": lambda h: h.split(".")[-1]}
    groups = {}
    for name, fn in cut.items():
        groups[name] = {}
        for host, (n, k) in level.items():
            a, b = groups[name].get(fn(host), (0, 0))
            groups[name][fn(host)] = (a + n, b + k)
    n, k = map(sum, zip(*level.values(), strict=True))
    above = {s: (k + 1) / (n + 2) for s in groups["suffix"]}
    for name, up in (("suffix", "suffix"), ("domain", "suffix"), ("host", "domain")):
        prior = {g: above[cut[up](g)] for g in groups[name]}
        over = sum((k - n * prior[g]) ** 2 - n * prior[g] * (1 - prior[g])
                   for g, (n, k) in groups[name].items())
        share = sum(n * (n - 1) * prior[g] * (1 - prior[g]) for g, (n, k) in groups[name].items())
        rho = min(0.9, max(0.001, over / share)) if share > 0 else 0.1
        m = (1 - rho) / rho
        above = {g: (k + m * prior[g]) / (n + m) for g, (n, k) in groups[name].items()}
    return {h: above[h] - 2 * (above[h] * (1 - above[h]) / (level[h][0] + m + 1)) ** 0.5
            for h in level}


def test_reputations(spark):
    rng = random.Random(3)
    outcomes = []
    for d in range(12):
        rate = rng.random()
        for h in range(4):
            host = f"h{h}.d{d}.{rng.choice(['net', 'info'])}"
            outcomes += [(host, int(rng.random() < rate)) for _ in range(rng.randrange(30))]
    outcomes += [("h9.d1.net", None), ("", None), ("alone", 1)] + [("big.d2.net", 1)] * 900
    frame = spark.createDataFrame(outcomes, "host string, bad long")
    got = {r.host: r.lower for r in host_reputation.reputations(frame).collect()}
    want = slow_lower_bounds(outcomes)
    assert got.keys() == want.keys()
    assert all(abs(got[h] - want[h]) < 1e-9 for h in want)

    # Verdicts follow from outcomes: of a hot host, of hosts, of an unseen host of a domain.
    pages = spark.createDataFrame(
        [(i, f"http://{h}/p") for i, (h, _) in enumerate(outcomes)], "page_id long, url string")
    known = frame.where("bad is not null").select(
        F.concat(F.lit("http://"), "host", F.lit("/q")).alias("url"), "bad")
    verdicts = {r.host: r.verdict for r in host_reputation.judge(pages, [], known).collect()}
    assert verdicts == {h: "block" if low > 0.5 else "allow" for h, low in want.items()}
    assert verdicts["big.d2.net"] == "block" and "allow" in verdicts.values()


def test_suffixes_of_two_labels(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.uk",), ("uk",), ("",)], "h string")
    got = hosts.select(host_reputation.domain_of(F.col("h"), ("co.uk",)).alias("d")).collect()
    assert [r.d for r in got] == ["b.co.uk", "b.uk", "uk", ""]


def slow_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(
        "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")))
        for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t in df if df[t] >= least]
        groups = {}
        for _, source, terms in own:
            groups.setdefault(source, Counter()).update(
                {t: n for t, n in terms.items() if df[t] >= least})

        def p(counts):
            return {t: 1 + 10 ** 9 * (counts[t] + 1) // (sum(counts.values()) + len(kept))
                    for t in kept}

        whole = p(sum(groups.values(), Counter()))
        probs = {s: p(c) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = [(t, sum((probs[s][x] - probs[t][x]) ** 2 // probs[t][x] for x in kept))
                     for t in groups if t != s]
            terms = [(x, (probs[s][x] - whole[x]) ** 2 // whole[x])
                     for x in kept if c[x] and probs[s][x] > whole[x]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, x, v, r) for r, (x, v) in enumerate(items, 1)
                        if part == "pair" or r <= top]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(9)
    vocabulary = [a + b for a in ("foo", "Bar", "é", "zu", "\u00a0x") for b in (
        "", "ish", "NESS", "ö", "ly")]
    rows = []
    for _ in range(200):
        lang = rng.choice(["en", "en", "de", None])
        words = rng.sample(vocabulary, 12) if lang == "en" else vocabulary
        rows.append((" ".join(rng.choice(words) + rng.choice(["", ",", "1", "_"]) for _ in range(
            rng.randrange(30))), lang, rng.choice(["a", "b", "c", None])))
    rows += [rows[3]] * 40 + [(rows[4][0], rows[4][1], s) for s in "abcd" * 5]
    rows += [(None, "en", "empty"), ("12 !", "en", "junk"), (None, "xx", None), ("", "xx", "b"),
             ("one two", "yy", "only"), ("long words " * 4000, "de", "a")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows],
                                 "text string, lang string, source string, n int, term string")
    got = source_audit.audit_sources(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_audit(rows)
    few = source_audit.audit_sources(docs, min_documents=20, top=2).collect()
    assert sorted(map(tuple, few)) == slow_audit(rows, 20, 2)
    assert source_audit.audit_sources(docs.limit(0)).count() == 0


def test_audit_in_parts(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "MAX_HELD", 1)
    monkeypatch.setattr(source_audit, "AT_ONCE", 2)
    rows = [("a b c", "en", "x"), ("a b", "en", "y"), ("a c c", "en", "x"), ("b a", "en", "y")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.audit_sources(docs).collect())) == slow_audit(rows)
