"""Each operator against brute force, and on null, empty, long, tied, repeated and oddly named input."""

import hashlib
import os
import random
import re
import sys
import time

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from phrasemine.llm import chat, decontaminate, exact_dedup, html_blocks, html_extract, mixing, secrets, simhash, spans, toxicity, warc
from phrasemine.llm.queries import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    long = words(r, 4000)
    base = [words(r, r.randint(1, 60)) for _ in range(40)]
    texts = [None, "", " \n ", "A", "a", long, long.upper(), long + "x", *base, *[b.capitalize() for b in base[:15]], *[b + " end" for b in base[:10]], "Ünï Ünï", "ünï Ünï"]
    out = [(i, t, "en", [None, "b", "a", "Z"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[9], out[9], (None, base[3], "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _key", "2 as key", "3 as _th", "4 as size", "5 as fp", "6 as n_units", "7 as _nth", "8 as `start`").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# exact dedup


def test_exact_groups(spark, docs, rows):
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(low(t), []).append(d)
    assert len(got) == len(rows)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = set()
        for i in ids:
            kept = i == keep and i not in seen
            seen.add(i)
            want.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_exact_copies(docs, rows):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [low(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({low(t) for _, t, *_ in rows})


def test_exact_groups_of_many_blocks(spark):
    """Names must tell apart texts that share all blocks but in another order or number."""
    b = exact_dedup.BLOCK
    parts = ["x" * b, "y" * b, "z" * b]
    texts = ["".join(parts[k] for k in o) for o in ((0, 1, 2), (0, 2, 1), (0, 1), (0, 1, 2, 0), (0, 0, 0), (0, 1, 2))] + ["".join(parts) + "q"]
    got = exact_dedup.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {0: 5, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}


# simhash


def test_a_row_repeated_very_often(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "PIECE", 1000)
    often = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    docs = often.union(spark.createDataFrame([(9, "Word " * 2000), (1, "x")], "doc_id long, text string"))
    got = exact_dedup.exact_groups(docs).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True, 1), (7, 9, 100_001, False, 100_000), (9, 9, 100_001, True, 1)]


def test_fingerprint_by_hand():
    import xxhash

    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    r = random.Random(1)
    for t in [None, "", "a b", "É é É A\x0bb", words(r, 4), words(r, 300), words(r, 70_000)]:
        assert simhash.fingerprint(t) == slow(t)


@pytest.mark.parametrize("n", [64, 43, 42, 28, 14, 9, 5, 4, 3, 2, 1])
def test_segments(n):
    """Of four bits in any places some segment holds at most one."""
    from itertools import combinations

    parts = simhash.segments(list(range(n)))
    assert sorted(b for p in parts for b in p) == list(range(n))
    r = random.Random(n)
    for four in [r.sample(range(n), min(4, n)) for _ in range(300)] if n > 14 else combinations(range(n), min(4, n)):
        assert any(len(set(p) & set(four)) <= 1 for p in parts) or n < 4


@pytest.mark.parametrize("pairwise", [simhash.PAIRWISE, 6])
def test_links_find_all_pairs(spark, pairwise):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for k in range(7):
            x = b
            for bit in r.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.roots(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), pairwise)).collect()
    root = {s: s for s in signed} | {g.node: g.root for g in got}
    arr = np.array(sorted(fps), dtype=np.uint64)
    parent = {int(x): int(x) for x in arr}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in arr:
        for y in arr[np.bitwise_count(arr ^ x) <= simhash.BITS]:
            parent[find(int(x))] = find(int(y))
    by = {}
    for f in fps:
        by.setdefault(find(f), set()).add(root[f - (1 << 64) if f >> 63 else f])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_near_duplicates(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert comp[0] == comp[1] == comp[2] == 0 and comp[3] == comp[4] and comp[5] == comp[6]
    assert all(c <= d for d, c in comp.items())
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(comp.values())
    assert simhash.near_duplicates(empty).count() == 0


# decontamination


def test_near_copies_without_ids(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve thirteen", "alpha beta gamma delta epsilon zeta"
    rows = [(None, a), (None, b), (5, b), (None, c), (None, c.upper()), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sha", "2 as least")
    kept = sorted(((r.doc_id or -1), r.text) for r in simhash.drop_near_copies(docs).collect())
    one = min((c, c.upper()), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert kept == sorted([(-1, a), (5, b), (-1, one), (3, "x y"), (3, "x y")])


def test_tiles_reordered():
    item, doc = decontaminate.word_ids("a b c d e f g h i j k"), decontaminate.word_ids("x g h i j k y a b c d e f z a b c")
    t = decontaminate.tiles(item, doc)
    assert sorted((i, k) for i, _, k in t) == [(0, 6), (6, 5)]
    assert decontaminate.tiles(item, doc[:2]) == []
    same = decontaminate.word_ids("a a a a a a a")
    assert sum(k for *_, k in decontaminate.tiles(same, same)) == 7


def test_tiles_against_brute_force():
    """No two equal free runs of LEAST words may be left over, and tiles are equal and apart."""
    r = random.Random(9)
    for _ in range(60):
        a, b = (decontaminate.word_ids(" ".join(r.choices("abcd", k=r.randint(0, 25)))) for _ in range(2))
        t = decontaminate.tiles(a, b)
        ma, mb = [0] * len(a), [0] * len(b)
        for i, j, k in t:
            assert (a[i : i + k] == b[j : j + k]).all() and not any(ma[i : i + k]) and not any(mb[j : j + k])
            ma[i : i + k], mb[j : j + k] = [1] * k, [1] * k
        n = decontaminate.LEAST
        assert not any((a[i : i + n] == b[j : j + n]).all() and not any(ma[i : i + n]) and not any(mb[j : j + n]) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


def test_matches(spark, docs, empty, monkeypatch):
    r = random.Random(4)
    item, clean, other = words(r, 40), words(r, 200), words(r, 30)
    w = item.split()
    moved = " ".join(w[20:] + ["between"] + w[:20])
    texts = [(1, clean), (2, f"{clean} {item.upper()}!"), (3, f"{moved} {clean}"), (4, " ".join(w[:25])), (5, None), (5, None), (6, item), (6, item), (None, item), (7, f"{clean} Zyx; wvu."), (8, f"x {other}"), (9, "zyx and wvu"), (10, "")]
    d = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, th int").selectExpr("*", "1 as `a.b`")
    bench = spark.createDataFrame([(7, item), (8, "zyx wvu"), (9, None), (None, other), (7, other), (7, item), (10, "single"), (11, "")], "item_id long, text string")
    want = {(2, 7): (1.0, False), (3, 7): (1.0, True), (6, 7): (1.0, False), (None, 7): (1.0, False), (7, 8): (1.0, False), (8, 7): (1.0, False), (8, None): (1.0, False)}
    for most in (decontaminate.MOST_SENT, 0):
        monkeypatch.setattr(decontaminate, "MOST_SENT", most)
        found = decontaminate.matches(d, bench).collect()
        assert {(x.doc_id, x.item_id): (round(x.coverage, 3), x.reordered) for x in found} == want and len(found) == len(want)
        left = decontaminate.drop_contaminated(d, bench)
        assert left.columns == d.columns and sorted(x.doc_id for x in left.collect()) == [1, 4, 5, 5, 9, 10]
        assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
        assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("most", [decontaminate.MOST_SENT, 0])
def test_matches_against_brute_force(spark, monkeypatch, most):
    """Each document tiled with each item, without seeds, where tiles of SEED words are enough to reach the coverage."""
    monkeypatch.setattr(decontaminate, "MOST_SENT", most)
    r = random.Random(8)
    stock = words(r, 7)
    items = [(k, " ".join(r.choices(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], k=r.randint(2, 40))) + " " + stock) for k in range(30)]
    docs = []
    for k in range(120):
        parts = words(r, r.randint(0, 60)).split()
        for _, text in r.sample(items, r.randint(0, 3)):
            w = text.split()
            cut = r.randint(0, len(w))
            pieces = [w[cut:], w[:cut]] if r.random() < 0.5 else [w[: int(len(w) * r.random())]]
            for x in pieces:
                at = r.randint(0, len(parts))
                parts[at:at] = x
        docs.append((k, " ".join(parts) + (" " + stock if k % 3 == 0 else "")))
    got = {(x.doc_id, x.item_id): round(x.coverage, 6) for x in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    must, may = {}, {}
    for d, text in docs:
        for i, item in items:
            a, b = decontaminate.word_ids(item), decontaminate.word_ids(text)
            share = lambda least: sum(k for *_, k in decontaminate.tiles(a, b, least)) / len(a)
            if (c := share(decontaminate.LEAST)) >= decontaminate.COVER:
                may[d, i] = round(c, 6)
                if share(decontaminate.SEED) >= decontaminate.COVER:
                    must[d, i] = round(c, 6)
    assert must.items() <= got.items() <= may.items() and len(must) > 60


def test_stock_phrase_makes_no_pairs():
    """A phrase that all items share brings no candidates, and items are still found."""
    r = random.Random(2)
    stock = words(r, 12)
    items = [(k, f"{words(r, 50)} {stock} {words(r, 40)}") for k in range(1000)]
    finder = decontaminate.Finder(decontaminate.Items.of(items, decontaminate.COVER))
    # but for the few whose words beside it happen to be the same
    assert len(finder.candidates(f"{words(r, 100)} {stock} {words(r, 100)}")[0]) <= 5
    assert [m[0] for m in finder.matches(f"x {items[77][1]} y", 0.8)] == [77]
    assert [list(finder.matches(t, 0.8)) for t in (None, "", stock[:4], " ".join(stock.split()[:3]))] == [[]] * 4


# mixing


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:  # share, stop at three times, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
            left -= target[s]
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    for s in order:
        n, want = sum(r.copies for r in got if r.source == s), target[s] / sizes[s] * sum(r.source == s for r in got)
        assert abs(n - want) <= 1
    assert mixing.mix(empty).count() == 0


# secrets


def spans_by_hand(t):
    found = []
    for i, (kind, p, least) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        for m in re.finditer(p, t or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark, empty):
    hex_ = "0123456789abcdef" * 2
    texts = [
        None, "", "nothing", f"é𝄞 password = hunter22 {hex_}", "secret=token:abcdefgh", "PASSWORD: 'abc' api_key=abcdef, apikey=\"x.y/z==9\"", "AKIA" + "A" * 16 + "AKIA" + "9" * 20, hex_ * 40 + "g" + hex_,
        "token = a token = abcdefg", f"user: bob\npwd: abcd\nhttps://db.example/x\n\npwd: lonely", "pwd: lonely", "user=bob", "client_id=abc123 " + "0123456789abcdef01", ("token: abcdef " * 3000),
    ]
    d = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3])], "doc_id long, text string")
    got = secrets.scan(d).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        base = spans_by_hand(t)
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == tuple(sum(s.startswith(k) for s in base.split(",")) for k in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(by[i].spans.split(","))
    assert by[9].spans == "weak_id:0:9,weak_key:10:19,endpoint:20:40"
    assert by[10].spans == by[11].spans == "" and by[12].spans == "weak_id:0:16,weak_key:17:35"
    assert secrets.scan(empty).count() == 0


def test_secrets_access_key_links(spark):
    key, hex_ = "AKIA" + "A1" * 8, "0123456789abcdef" * 2
    near = f"{key} secret=abcdefgh https://db.example/x"
    texts = [near, f"{key}\n{hex_}\nhost: db.example", f"{key}\n\nsecret=abcdefgh https://db.example/x", f"{key} https://db.example/x", near + "\n\npwd: lonely"]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got[0] == got[4] == "access:0:20,assign:21:36,endpoint:37:57"
    assert got[1] == "access:0:20,hex:21:53,endpoint:54:70"
    assert "endpoint" not in got[2] and "endpoint" not in got[3]


def linked_by_hand(text):
    """All spans, by a loop over all pairs of parts."""
    parts = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate([*secrets.BASE, *secrets.WEAK]) for m in re.finditer(p, text) if len(m[g]) >= least]
    breaks = [m.start() for m in re.finditer(secrets.BREAK[1], text)]

    def near(a, others):
        return any(abs(a[0] - o[0]) <= secrets.WINDOW and sum(x < a[0] for x in breaks) == sum(x < o[0] for x in breaks) for o in others)

    strong, ids = [p for p in parts if p[1] in (0, 2, 4)], [p for p in parts if p[1] in (1, 3)]
    linked = [p for p in strong if near(p, ids)]
    kept = [p for p in parts if p[1] < 3] + [p for p in linked if p[1] == 4] + [p for p in ids if p[1] == 3 and near(p, strong)] + [p for p in parts if p[1] == 5 and near(p, linked)]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(kept))


def test_secret_links_against_all_pairs(spark):
    """Parts of every kind in random order, 1 to 400 code points and now and then a blank line apart."""
    r = random.Random(8)
    pieces = ["user=bob", "client_id: a1b2c3", "pwd: s3cr", "0123456789abcdef01", "https://db.example/x", "host=db.example", "AKIA" + "B2" * 8, "token=abcdefgh", "0123456789abcdef" * 2]
    gaps = [" ", "\n", "\n\n", "\n \t\n", " é" * 40, " zz" * 65, " zz" * 68, " q" * 200]
    texts = ["".join(r.choice(pieces) + r.choice(gaps) for _ in range(r.randint(2, 12))) for _ in range(300)]
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    want = [linked_by_hand(t) for t in texts]
    assert [got[i] for i in range(len(texts))] == want and sum("weak" in w for w in want) > 100


# warc


@pytest.mark.parametrize("most", [warc.MOST_SENT, 0])
def test_warc(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_SENT", most)
    big, r = "<p>é" + "x" * 1200, random.Random(2)
    pages = [(1, "u1", big), (5, "u5", big), (3, None, big), (2, "a\r\nb", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "line\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + words(r, 400)), (5, "u5", big)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as sha256", "2 as keep")
    archive = warc.write_archive(d)
    stored = spark.read.parquet(archive.payloads).collect()
    assert len(stored) == len({(h or "") for *_, h in pages}) and all(hashlib.sha256(s.payload).hexdigest() == s.sha256 for s in stored)
    got = warc.parse(warc.read_records(spark, archive)).collect()
    assert len(got) == len(pages)
    html = {i: (h or "").encode() for i, _, h in pages}
    for x in got:
        p = html[x.page_id]
        assert (x.payload_bytes, x.payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
        revisit = p == big.encode() and x.page_id != 5
        assert (x.record_type, x.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert x.payload is None if revisit else bytes(x.payload) == p
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_notices_damage(spark):
    a = warc.write_archive(spark.createDataFrame([(1, "u", "abc" * 500)], "page_id long, url string, html string"))
    bad = spark.read.parquet(a.payloads).selectExpr("sha256", "bytes", "cast(reverse(cast(payload as string)) as binary) as payload")
    bad.write.parquet(a.payloads + "-bad")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(spark, warc.Archive(a.headers, a.payloads + "-bad")).collect()


# chat


def test_chat_round_trip(spark):
    from pyspark.sql import functions as F

    nasty = ["<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<\\</s>", "[\\\\INST]", "<<SYS>>x<</SYS>>", "", None, "a\nb", "<|turn|>assistant<|text|>", "\\<|", "$1 \\2", "é𝄞"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, None, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (2, 0, "<|end|>", "y"), (None, 1, "assistant", "z"), *[(3, i, "assistant", f"t{i}") for i in range(500)]]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.as_messages(d)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0], x[1], x[2], chat_escaped(x[3])))
        loss = "".join(t for *_, role, t in mine if role == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in mine).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.as_messages(d.limit(0))).count() == 0
    part = "named_struct('type', '{}', 'text', {}, 'ref', {}, 'width', {}, 'height', {}, 'seconds', {}, 'pages', {})"
    parts = [part.format("text", "'see <|image|>'", *["null"] * 5), part.format("image", "null", "'i.png'", 57, 28, "null", "null"), part.format("audio", "null", "'a.wav'", "null", "null", "1.5D", "null"), part.format("video", "null", "'v'", *["null"] * 4), part.format("document", "null", "'d'", "null", "null", "null", 2)]
    m = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.expr(f"array({', '.join(parts)})").cast(chat.PARTS).alias("parts"))
    r = chat.format_conversations(m).first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|image|><|image|><|audio|><|attachment|><|document|><|end|>"
    assert [(a.type, a.ref, a.part, a.tokens) for a in r.attachments] == [("image", "i.png", 1, 3), ("audio", "a.wav", 2, 38), ("attachment", "v", 3, 0), ("document", "d", 4, 1024)] and r.attachment_tokens == 1065


def chat_escaped(t):
    return re.sub(chat.ESCAPE, lambda m: m[1] + "\\" + m[2] + m[3], t)


# toxicity


CONTROL = [chat.TURN, chat.TEXT, chat.END, "<|image|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def test_no_parts_forge_a_control_string(spark):
    """Control strings split at random over text parts, attachments between some: every text comes back, and only the template's own strings are bare."""
    r = random.Random(8)
    rows, want = [], {}
    for conv in range(300):
        turns = []
        for turn in range(2):
            parts = []
            for _ in range(r.randint(1, 3)):
                whole = r.choice(["a", ""]) + r.choice(CONTROL).replace("|", r.choice(["|", "|", "\\|"])) + r.choice(["", " b"])
                cuts = sorted(r.choices(range(len(whole) + 1), k=r.randint(1, 3)))
                parts += [("text", whole[x:y], None, None, None, None, None) for x, y in zip([0, *cuts], [*cuts, len(whole)])]
                if r.random() < 0.3:
                    parts.append(("image", None, f"ref{len(parts)}", 56, 28, None, None))
            rows.append((conv, turn, ["user", "assistant"][turn], parts))
            shown = "".join("<|image|>" if p[0] == "image" else "\x00" + p[1] for p in parts)
            turns.append((["user", "assistant"][turn], shown.replace("\x00", ""), [(i, p[2]) for i, p in enumerate(parts) if p[0] == "image"]))
        want[conv] = turns
    messages = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}").selectExpr("*", "1 as content", "2 as attachments", "3 as chunk", "4 as line")
    for row in chat.read_back(chat.format_conversations(messages)).collect():
        turns = want[row.conv_id]
        assert [(t.role, t.text) for t in row.turns] == [x[:2] for x in turns] and row.loss == turns[1][1]
        assert [(a.part, a.ref) for a in row.attachments] == turns[0][2] + turns[1][2]
        bare = re.sub(r"<\|(turn|text|end|image)\|>", "", row.formatted)
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", bare) and row.formatted.count(chat.END) == 2 and row.formatted.count(chat.TURN) == 2


def test_very_long_turns(spark):
    text = "<|end|> x" * 300_000
    messages = chat.as_messages(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string"))
    row = chat.read_back(chat.format_conversations(messages)).first()
    assert row.loss == text and [t.text for t in row.turns] == ["q", text]


def test_states_of_the_automaton_are_bounded(monkeypatch):
    import gc

    monkeypatch.setattr(toxicity, "MOST_STATES", 500)
    r = random.Random(9)
    terms = ["".join(r.choices("abcdefgh", k=r.randint(9, 12))) for _ in range(60)]
    automaton = toxicity._Automaton({t: i for i, t in enumerate(terms)}, {})
    for _ in range(20_000):
        term = list(r.choice(terms))
        term[r.randrange(len(term))] = r.choice("abcdefgh")
        automaton.match("".join(term))
        assert len(automaton.states) <= 520
    gc.collect()
    assert sum(isinstance(x, toxicity._State) for x in gc.get_objects()) <= 1100


def test_automaton_against_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = {w: i for i, w in enumerate(["idiot", "moron", "pathetic", "disgusting", "scum", "idiots"])}
    a, r = toxicity._Automaton(terms, {}), random.Random(8)
    for _ in range(3000):
        w = list(r.choice(list(terms)))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "x", "i", "o"])
        w = "".join(w)
        fits = [(distance(w, t), i) for t, i in terms.items() if distance(w, t) <= a.allowed(t)]
        got = a.match(w)
        assert (got is None) == (not fits) and (not fits or (got[1], got[0]) == min(fits)), (w, got, fits)


def test_toxicity_learns(spark, empty):
    from pyspark.sql import functions as F

    r, bad = random.Random(6), ["zorkish", "grumblet", "snarfed"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(r, 30).split()
        if toxic:
            for t in r.sample(bad, 2):
                w.insert(r.randint(0, len(w)), t)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame([*rows, (None, None), (601, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert model == toxicity.fit(d.repartition(5), lab)
    got = {x.doc_id: x for x in toxicity.score(d.withColumn("score", F.lit(1)), model).collect()}
    held = [i for i in range(600) if got[i].held_out]
    import zlib

    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    f = toxicity.score_column(model)
    s = [x[0] for x in spark.createDataFrame([(rows[1][1] + " zorkiish gruumblet",), (rows[1][1],), ("",), (None,)], "t string").select(f("t")).collect()]
    assert s[0] > 0.5 > s[1] and s[2] < 0.5 and s[2] == s[3]
    quoted, plain = "you zorkish grumblet " + words(r, 20), 'he said "zorkish grumblet" ' + words(r, 20)
    m = toxicity._Matcher(model)
    assert toxicity.features(quoted, m)[0] > 0 and toxicity.features(plain, m)[0] == 0 and toxicity.features(plain, m)[3] > 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(d, lab.limit(0))
    assert {x.predicted for x in toxicity.score(d, none).collect()} == {0}
    left = toxicity.drop_toxic(d, model)
    assert left.columns == d.columns and left.count() < d.count()


def test_toxicity_learns_short_terms_and_many(spark):
    """Terms of any length, as many as the sample bears out; a very long text is scored whole."""
    r = random.Random(16)
    bad = ["zog", "vx", *["q" + "".join(r.choices("uvwxyz", k=6)) for _ in range(300)]]
    rows, labels = [], []
    for i in range(6000):
        w = words(r, 12).split()
        if i % 2:
            for t in r.sample(bad[2:], 3) + r.choices(bad[:2], k=1):
                w.insert(r.randint(0, len(w)), t)
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = {t for t, is_prefix, _ in model["lexicon"] if not is_prefix}
    assert {"zog", "vx"} <= known and len(known) > 240
    m = toxicity._Matcher(model)
    long = words(r, 150_000)
    assert toxicity.features(long, m)[5] == 0 and toxicity.features(long + " zog", m)[5] > 0


# substring dedup


def brute_repeats(rows):
    """Units to remove, by text: every run of RUN units against all earlier places, one document after the other."""
    n, seen, gone = spans.RUN, {}, {}
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        u, drop, firsts = spans.units(t), set(), set()
        for i in range(len(u) - n + 1):
            first = seen.setdefault(tuple(u[i : i + n]), (d, t, i))
            if first != (d, t, i):
                drop |= set(range(i, i + n))
                firsts.add(first[0])
        gone[d, t] = drop, firsts
    return gone


def test_repeats_against_brute_force(spark):
    r = random.Random(21)
    talk = ["Yes. ", "No! ", "Tea or rice? ", "A b c d.\n", "Oil\n", "And so on and on. "]
    pool = [*talk, *[words(r, r.randint(1, 40)) + r.choice(".!?") + " " for _ in range(12)]]
    rows = [(i, "".join(r.choices(pool, k=r.randint(0, 14)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "\n\n"), (153, pool[7] * 12), rows[9], rows[9], (None, rows[3][1]), (None, rows[3][1]), (9000, "".join(pool) * 20)]
    want = brute_repeats(rows)
    # texts under one doc_id have an order of their own, so that is left out here
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as th", "3 as N_Removed", "4 as a")
    got = spans.remove_repeats(d.repartition(5))
    assert got.columns == ["doc_id", "text", "a.b", "th", "a", "n_removed", "first_doc_ids"]
    got = got.collect()
    assert len(got) == len(rows) and sum(x.n_removed > 0 for x in got) > 50
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    for doc_id, text in set(rows):
        drop, firsts = want.get((doc_id, text), (set(), set()))
        for x in by[doc_id]:
            b = spans.bounds(text) if text else [0]
            assert x.text == (text if text is None else "".join(text[b[k] : b[k + 1]] for k in range(len(b) - 1) if k not in drop) if drop else text)
            assert x.n_removed == len(drop) and set(x.first_doc_ids or []) == firsts
    changed = spans.remove_repeats(d, True)
    assert sorted(str(x) for x in changed.collect()) == sorted(str(x) for x in got if x.n_removed)


def test_repeats_of_hot_runs_against_brute_force(spark, monkeypatch):
    """Runs that a sample shows to be common are dealt over many tasks; nothing changes but that."""
    for name, value in (("HOT", 40), ("PROOF", 3), ("DEALS", 5), ("SAMPLE", 0.9)):
        monkeypatch.setattr(spans, name, value)
    r = random.Random(22)
    notice, other = ["".join(words(r, 6).capitalize() + ". " for _ in range(6)) for _ in range(2)]
    rows = [(i, words(r, 20) + ". " + notice * r.randint(0, 2) + words(r, 9) + ". " + (other if i % 50 == 0 else "")) for i in range(300)]
    rows += [(i, notice) for i in range(300, 340)] + [(300, notice)] * 3 + [(-1, notice + "End.")] * 3 + [(None, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hot = spans._hot(d.selectExpr("*", "0L as th"))
    assert set(spans.run_hashes(spans.units(notice))[0]) <= set(hot) and not set(spans.run_hashes(spans.units(other))[0]) & set(hot)
    want = brute_repeats(rows)
    got = spans.remove_repeats(d.repartition(5)).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for x in got:
        text = by[x.doc_id]
        drop, firsts = want[x.doc_id, text]
        b = spans.bounds(text)
        assert x.n_removed == len(drop) and set(x.first_doc_ids or []) == firsts - {None}
        assert x.text == "".join(text[b[k] : b[k + 1]] for k in range(len(b) - 1) if k not in drop)


def test_runs_take_one_narrow_shuffle(spark):
    """Bytes of shuffle and scratch tables a run, of texts without repeats: one shuffle, and no table of all runs."""
    r = random.Random(23)
    letters = "abcdefghijklmnoprstuvwy"
    rows = [(i, " ".join("".join(r.choices(letters, k=6)) + "." * (k % 5 == 4) for k in range(1000))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()

    def written():
        time.sleep(1)  # the figures come a little later than the job's end
        spark.range(1).collect()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before, made = written(), []
    stash = spans.stash

    def noted(df, name):
        made.append(stash(df, name))
        return made[-1]

    spans.stash, spans.forget, forget = noted, lambda df: None, spans.forget
    try:
        assert spans.repeated_units(d).count() == 0
    finally:
        spans.stash, spans.forget = stash, forget
    size = sum(os.path.getsize(os.path.join(at, f)) for t in made for at, _, fs in os.walk(t.stash_path) for f in fs)
    n = sum(len(spans.units(t)) - spans.RUN + 1 for _, t in rows)
    took = written() - before
    assert n > 30_000 and 12 * n < took + size < 30 * n


def test_repeats_of_short_sentences_and_notices(spark, empty):
    lines = [f"{a} {b}.\n" for a in ("tea", "rice", "oil") for b in ("one", "two", "six", "ten")]
    talk = "Yes. No. Why? So. Ah. "
    d = spark.createDataFrame([(1, "".join(lines)), (2, "Other words here.\n" + "".join(lines).upper() + "End."), (3, talk + "Then one left."), (4, "They spoke again. " + talk), (5, "Yes. No. Why? But here it differs.")], "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_removed, x.first_doc_ids) for x in spans.remove_repeats(d).collect()}
    assert got[2] == ("Other words here.\nEnd.", 12, [1]) and got[4] == ("They spoke again. ", 5, [3])
    assert all(got[i][1] == 0 for i in (1, 3, 5))
    assert spans.remove_repeats(empty).count() == 0


def test_repeats_come_into_step(spark):
    r = random.Random(9)
    latin = lambda n: " ".join("".join(r.choices("abcdefghijklmnoprstuvwy", k=r.randint(2, 8))) for _ in range(n))
    cyrillic = lambda n: " ".join("".join(r.choices("абвгдежзиклмнопрстуфхцчшя", k=r.randint(2, 8))) for _ in range(n))
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n))
    rows = []
    for k, (make, gap, size) in enumerate([(latin, " ", 60)] * 9 + [(cyrillic, " ", 60)] * 9 + [(han, "", 120)] * 9):
        shared, before = make(size), make(k % 9 + 1)
        rows += [(2 * k, shared + gap + make(7), 0), (2 * k + 1, before + gap + shared + gap + make(5), size)]
    stops = "。".join(han(8) for _ in range(5)) + "。"
    rows += [(100, stops, 0), (101, han(9) + "。" + stops, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = {x.doc_id: x for x in spans.remove_repeats(d).collect()}
    for doc_id, text, size in rows[:-2]:
        out = got[doc_id]
        if size:
            assert out.first_doc_ids == [doc_id - 1], text
            cut = len(text.split()) - len(out.text.split()) if " " in text else len(text) - len(out.text)
            assert cut >= size / 3, text
        else:
            assert out.n_removed == 0
    assert got[101].n_removed == 5 and got[101].text == rows[-1][1][:10]


def test_passages_of_over_50_words_are_seen():
    """Wherever they start and stand; clean texts have no run in common."""
    r = random.Random(13)
    text = lambda n: " ".join(words(r, min(60, int(r.expovariate(1 / 11)) + 1)).capitalize() + r.choice(".,.!?") for _ in range(n)).split()
    runs = lambda t: {tuple(u[i : i + spans.RUN]) for u in [spans.units(" ".join(t))] for i in range(len(u))} if t else set()
    full = lambda t: {x for x in runs(t) if len(x) == spans.RUN}
    seen = 0
    for _ in range(400):
        a, b, c = text(12), text(12), text(30)
        k, x, y = r.randrange(len(c) - 51), r.randrange(len(a)), r.randrange(len(b))
        p = c[k : k + 51]
        seen += bool(full(a[:x] + p + a[x:]) & full(b[:y] + p + b[y:]))
        assert not full(a) & full(b)
    assert seen >= 396


def test_query_keeps_all_documents(spark):
    from phrasemine.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op10_substring_dedup"](spark, sf).collect()
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(want) and any(r.n_removed for r in got) and not all(r.n_removed for r in got)
    drops = brute_repeats(list(want.items()))
    assert all(r.n_removed == len(drops.get((r.doc_id, want[r.doc_id]), (set(),))[0]) and (r.n_removed or r.text == want[r.doc_id]) for r in got)


def test_units_tile_texts():
    r = random.Random(3)
    texts = ["", "a", " . ", "x" * 5000, words(r, 500), "A b.\n\nC d!! e f? ", "1.5 and\r\n2", "İİ İx. " * 9, "ΑΣ ΣΑΣ. " * 30, "".join(r.choices("ab .!?\n\t。İ漢", k=3000)), words(r, 200_000)]
    for t in texts:
        u, b = spans.units(t), spans.bounds(t)
        assert b[0] == 0 and b[-1] == (len(t) if u else 0) and len(b) == len(u) + 1 and b == sorted(b)
        pieces = [t[x:y] for x, y in zip(b, b[1:])]
        assert ["".join(p.lower().split()) for p in pieces] == ["".join(x.split()) for x in u]
        assert all(len(p.split()) <= spans.LONG for p in pieces)
    assert spans.units("A b.\n\nC d!! e 1.5 f? ") == ["a b.", "c d!!", "e 1.5 f?"]


# html


def test_blocks():
    page = "<html><head><title>t</title></head><body><p>a&amp;b &lt;c&gt;<br>d\n  e<p>f <b>g</b><div>h<script>x<p></script>i</div><table><tr><td>j<td>k</table><!-- <p>no</p> --><ul><li>l<li>m</ul><p hidden>n</p>5 < 6"
    assert [b.text for b in html_blocks.blocks(page)] == ["a&b <c> d e", "f g", "hi", "j", "k", "l", "m", "5 < 6"]
    assert html_blocks.blocks(None) == [] == html_blocks.blocks("") and [b.text for b in html_blocks.blocks("x &nbsp; y")] == ["x y"]


@pytest.mark.parametrize("page, want", [
    ("<body><article><p class=it's>First one here.</p><p>It's a second.</p></article>", ["First one here.", "It's a second."]),
    ('<p class="x>text</p>', ["text"]),
    ('<head><script>var a = "</head>"; run()</script><title>t</title></head><body>x</body>', ["x"]),
    ("<p title='a > b' data-x=\"<p>no</p>\">yes</p>", ["yes"]),
    ("a<script>x</scripty></script>b<style>c</style >d<textarea><p>e</textarea>f", ["abdf"]),
    ("<p>a<!-- > <p>b --><!doctype x><?y <p> ?></ z>c</p><!-- open <p>d", ["a ?>c"]),
    ("x < y <3 </> z<", ["x < y <3 z<"]),
    ("a<svg><text>b</text></svg>c<p>d<svg>e", ["ac", "de"]),
    ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><dl><dt>f<dd>g</dl><table><tr><td>h<p>i<td>j<tr><td>k</table>", list("abcdefghijk")),
    ("<div hidden><p>a</div>b<p style='x:y; Display : NONE'>c<p>d", ["b", "d"]),
    ("<br class=a/>b<p/ id=c>d<a href=/e/>f</a>g<p>&amp;lt; &copy h&#x41;", ["b", "dfg", "&lt; © hA"]),
    ("whole <a href='cut", ["whole"]),
])
def test_blocks_of_odd_markup(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


@pytest.mark.parametrize("piece", ['<a href="x ', "<p class='", "<div>", "<svg>", "<!--", "<", "<x y=", "</p>", "<ul><li>", "<p>a<div>", "<table><tr><td>b", "<textarea>", "<b ==", "&", "<a "])
def test_blocks_take_linear_time(piece):
    import time

    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        html_blocks.blocks("<p>" + piece * (n // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 15 and took[1] < 40 * max(took[0], 0.02), (piece, took)


def test_extraction_of_other_software(spark):
    """Pages of a second writer that shares nothing with the training pages."""
    import json
    from collections import Counter

    from site_pages import TEMPLATES, site_page

    m = json.loads(html_extract.fit())
    right = total = whole = 0
    for t in TEMPLATES:
        for k in range(20):
            page, want = site_page(t, k)
            found = html_blocks.blocks(page)
            labels, left = html_extract.decode(found, m["weights"], m["trans"]), Counter(want.split("\n"))
            for b, y in zip(found, labels):
                left[b.text] -= (truth := left[b.text] > 0)
                right, total = right + (truth == bool(y)), total + 1
            whole += "\n".join(b.text for b, y in zip(found, labels) if y) == want
    assert right / total > 0.99 and whole > 0.85 * 20 * len(TEMPLATES)


def test_extraction_of_a_very_long_page_and_none(spark):
    para = "<p>" + "Some words of a long article, one after the other. " * 40 + "</p>"
    page = f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A title</h1>{para * 1500}</article><footer>© 2020</footer></body>"
    d = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").selectExpr("*", "1 as `a.b`", "2 as n_chars", "3 as Text")
    got = html_extract.extract(d).first()
    assert got.text.count("\n") == 1500 and got.n_chars == len(got.text) and "Home" not in got.text and "©" not in got.text
    assert html_extract.extract(d.limit(0)).count() == 0 and html_extract.extract(d).columns == ["page_id", "url", "text", "n_chars"]


def test_viterbi_against_all_paths():
    from itertools import product

    r = random.Random(1)
    for _ in range(50):
        w = {f: [r.gauss(0, 1), r.gauss(0, 1)] for f in "abcde"}
        trans = [[r.gauss(0, 1), r.gauss(0, 1)] for _ in range(2)]
        b = [html_blocks.Block("", r.sample("abcde", 2)) for _ in range(r.randint(1, 6))]
        score = lambda y: sum(w[f][k] for x, k in zip(b, y) for f in x.features) + sum(trans[i][j] for i, j in zip(y, y[1:]))
        assert score(html_extract.decode(b, w, trans)) == pytest.approx(max(map(score, product((0, 1), repeat=len(b)))))


def test_extraction_of_unseen_pages(spark):
    import json

    m = json.loads(html_extract.fit())
    right = total = 0
    for x, y in html_extract.training_set(150, seed=99):
        got = html_extract.decode([html_blocks.Block("", f) for f in x], m["weights"], m["trans"])
        right, total = right + sum(a == b for a, b in zip(got, y)), total + len(y)
    assert right / total > 0.98
    page = "<body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title here</h1><p>First para, with words in it.</p><p>Second &eacute; para goes here.</p></article><section id='comments'><p>Bob says: nice one, really</p></section><footer>© 2024</footer></body>"
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page)], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = [tuple(r) for r in html_extract.extract(d).orderBy("page_id").collect()]
    want = "Title here\nFirst para, with words in it.\nSecond é para goes here."
    assert got == [(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (3, "v", "", 0)]


# SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_agrees(spark, name):
    import duckdb

    from phrasemine.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall()
    show = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(map(tuple, got.select(*cols).collect())) == show(want)
