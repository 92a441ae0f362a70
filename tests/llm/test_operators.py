"""Each operator against brute force on small tables, and its defined results on awkward ones."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.llm import decontamination as decon
from sparkrank.llm import language_id as lang
from sparkrank.llm import packing, paragraph_dedup, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity
from sparkrank.llm.common import crc_mod_py
from sparkrank.llm.suffix_array import permuted_prefixes, suffix_array

SYLLABLES = ["ba", "do", "ki", "lu", "me", "no", "pra", "qui", "ro", "stu", "ta", "vex", "zé", "ño"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    passage = prose(rng, 70).replace("\n", " ").strip(". ") + "."
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(20, 120))
        if i % 6 == 0:
            words += " " + passage + " " + prose(rng, 10)
        rows.append((i, words))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    near = rows[7][1].split(" ")
    near[3] = "changed"
    rows += [(200, " ".join(near)), (201, None), (202, ""), (203, " \n\t "), (204, "x" * 40), (205, "ab " * 400), (206, "1234 !!"), (None, rows[8][1]), (207, rows[9][1]), (207, rows[9][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.fixture(scope="module")
def awkward(corpus):
    """The same rows with other columns whose names clash with what operators make."""
    df, _ = corpus
    return df.withColumns({c: F.lit("clash") for c in ("score", "fp", "unit", "length", "words", "hashes", "lang", "_id", "kept", "n_words", "start")})


def brute_dedup(rows, k=50):
    raw = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - k + 1):
            s = b[p : p + k]
            least[s] = min(least.get(s, float("inf")), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - k + 1):
            if least[b[p : p + k]] < i:
                gone[p : p + k] = [True] * k
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((None if i == float("inf") else int(i), len(b), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for t in range(150):
        a = rng.integers(0, rng.choice([1, 2, 3, 256]), rng.integers(1, 70)).astype(np.uint8)
        a = np.tile(a[: max(1, len(a) // 7)], 9) if t % 5 == 0 else a
        b = a.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array(a)
        assert list(sa) == order
        common, _ = permuted_prefixes(a, sa)
        for i, j in zip(order[1:], order):
            n = next((x for x in range(len(b)) if i + x >= len(b) or j + x >= len(b) or b[i + x] != b[j + x]), len(b))
            assert common[i] == n


def test_suffix_dedup(corpus, awkward):
    out = suffix_dedup.suffix_dedup(awkward)
    assert sorted(str(tuple(r)) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_dedup(corpus[1])
    full = suffix_dedup.suffix_dedup(corpus[0], with_text=True).where("n_removed > 0").first()
    assert len(full["spans"]) == 2 * full["n_spans"] and len(full["kept"]) == full["n_bytes"] - full["n_removed"]


def test_suffix_dedup_deals_crowded_minimizers_string_by_string(spark, corpus):
    df, rows = corpus
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in suffix_dedup.suffix_dedup(df, hot=2).select(*names).collect()) == brute_dedup(rows)
    # One passage, too short to be removed by itself, in 20,000 contexts; every tenth context has a copy.
    rng = random.Random(8)
    hot = "a passage of just thirty bytes"
    made = []
    for k in range(20_000):
        made.append((k, f"{made[k - 1][1]}" if k % 10 == 1 else f"{rng.getrandbits(60):x} {hot} {rng.getrandbits(60):x}"))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(made, "doc_id long, text string"), hot=100).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(got) == len(made) and all(r["n_removed"] == (r["n_bytes"] if r["doc_id"] % 10 == 1 else 0) for r in got)


def test_simhash(corpus, awkward):
    _, rows = corpus
    prints = [(i, simhash.fingerprint(t or "")) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(str((i, f"{f:016x}", least.get(find(k)))) for k, (i, f) in enumerate(prints))
    assert sorted(str(tuple(r)) for r in simhash.simhash_components(awkward).collect()) == want
    kept = simhash.one_of_each(awkward)
    assert kept.count() == len({find(k) for k in range(len(prints))}) and kept.columns == awkward.columns


def test_fingerprint_follows_its_definition(monkeypatch):
    import re

    import xxhash

    rng = random.Random(21)
    texts = ["", " \n", "One", "a b C", "Zé ÀB x\x85y  q\x1cr", prose(rng, 4), prose(rng, 300), "ab " * 50, "x" * 5000, *(prose(rng, rng.randint(1, 40)) for _ in range(60))]
    for block in (simhash.BLOCK_BYTES, 7):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
        for text in texts:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            words = re.findall("[^\x20\x09-\x0D]+", low)
            shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
            hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
            want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
            assert simhash.fingerprint(text) == want


def test_follow_the_leader_is_the_published_update():
    rng = np.random.default_rng(22)
    model, z, n = quality_classifier.FollowTheLeader(4), [0.0] * 17, [0.0] * 17
    q = quality_classifier
    for _ in range(200):
        at, y = rng.choice(17, 5, replace=False), int(rng.integers(2))
        x = rng.normal(size=5)
        w = [0.0 if abs(z[i]) <= q.L1 else -(z[i] - (q.L1 if z[i] > 0 else -q.L1)) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2) for i in at]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / q.ALPHA
            z[i], n[i] = z[i] + g - sigma * wi, n[i] + g * g
        model.update(at, x, float(y))
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)


def test_toxicity_gradient_is_that_of_the_non_negative_risk():
    rng = np.random.default_rng(23)
    loss = lambda g: np.log1p(np.exp(-g))
    logistic = lambda g: 1 / (1 + np.exp(-g))
    for prior, shift in ((0.3, 0.0), (0.1, 2.0), (0.6, -6.0), (0.9, -4.0)):
        gp, gu = rng.normal(size=6), rng.normal(size=9) + shift
        clean = lambda gp, gu: np.mean(loss(-gu)) - prior * np.mean(loss(-gp))  # noqa: E731,B023
        target = (lambda gp, gu: prior * np.mean(loss(gp)) + clean(gp, gu)) if clean(gp, gu) >= 0 else (lambda gp, gu: -clean(gp, gu))  # noqa: B023
        dp, du = toxicity.gradient(logistic(gp), logistic(gu), prior)
        for g, d in ((gp, dp), (gu, du)):
            for k in range(len(g)):
                old, e = g[k], 1e-6
                g[k] = old + e
                up = target(gp, gu)
                g[k] = old - e
                down = target(gp, gu)
                g[k] = old
                assert (up - down) / (2 * e) == pytest.approx(d[k], abs=1e-6)


def test_toxicity_cut_is_the_least_estimated_error():
    rng = np.random.default_rng(24)
    p, u, prior = rng.normal(2, 1, 50), np.concatenate([rng.normal(2, 1, 30), rng.normal(-2, 1, 170)]), 0.15
    wrong, cut = toxicity.best_cut(p, u, prior)
    error = lambda c: prior * np.mean(p < c) + max(0, np.mean(u >= c) - prior * np.mean(p >= c))
    assert error(cut) == pytest.approx(wrong) and all(error(c) >= wrong - 1e-12 for c in np.linspace(-6, 6, 2000))


def test_bundles_add_bound_letters():
    letters = lang.Letters(64)
    for text in ("Ab c", "日本 ß", "a", "Ωω7"):
        low = [0, *(ord(c.lower()) if c.isalpha() else 0 for c in text), 0]
        total = np.zeros(64)
        for k in range(len(low) - 2):
            if any(low[k : k + 3]):
                total += np.prod([np.roll(letters.vector(x), 2 - j) for j, x in enumerate(low[k : k + 3])], axis=0)
        ((places, v),) = letters.bundles([text, "12"])
        assert places == [0] and v[0] == pytest.approx(total / np.linalg.norm(total), abs=1e-5)
    assert len({letters.vector(c).tobytes() for c in range(0x400, 0x500)}) == 256


def test_simhash_ring_is_complete():
    rng = random.Random(1)
    for chain in (2, 3, 4):
        for _ in range(100):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << bit
            hits = any((a ^ b) & int(simhash.ring(s)[chain - 1]) in set(simhash.variants(s, chain).tolist()) for s in range(5))
            assert hits


def test_simhash_links_many_close(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(150)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    for crowd in (simhash.CROWD, 100, 20, 2):
        found = {x: x for x in fps}

        def root(x):
            while found[x] != x:
                x = found[x]
            return x

        for r in simhash.links(df, crowd).collect():
            a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
            assert (a ^ b).bit_count() <= 4
            found[root(a)] = root(b)
        assert len({root(x) for x in fps}) == len({find(x) for x in fps})


def test_paragraph_dedup(corpus, awkward):
    _, rows = corpus
    gone = paragraph_dedup.removals(awkward).collect()
    texts = {(i, t) for i, t in rows}
    by_id = {i: (t or "").encode() for i, t in texts}
    # What goes is, word set for word set, similar to something in the document that keeps it.
    shingles = lambda raw: {tuple(w[k : k + 5]) for w in [raw.lower().split()] for k in range(len(w) - 4)}
    for r in gone:
        assert r["doc_id"] is None or r["kept_doc_id"] < r["doc_id"]
        own = by_id[r["doc_id"]][r["start"] : r["end"]]
        kept = shingles(by_id[r["kept_doc_id"]])
        assert len(shingles(own) & kept) >= 0.8 * len(shingles(own)) * 0.8
    flagged = {r["doc_id"] for r in gone}
    assert {6 * k for k in range(1, 10)} <= flagged and set(range(101, 105)) <= flagged and 200 in flagged  # passages, copies, near copy
    assert not flagged & {1, 2, 3, 4, 5, 7, 8, 9, 201, 202, 203, 206}
    out = paragraph_dedup.cleaned(awkward, paragraph_dedup.removals(awkward))
    assert out.columns == awkward.columns and out.count() == len(rows)
    lengths = {r["doc_id"]: len(r["text"] or "") for r in out.collect()}
    assert lengths[6] < len(dict(rows)[6]) and lengths[1] == len(dict(rows)[1])


def test_bands_are_tuned():
    r, b = paragraph_dedup.tuned()
    assert 1 - (1 - 0.8**r) ** b >= paragraph_dedup.RECALL > 1 - (1 - 0.8**r) ** (b - 1)


def test_paragraph_recall_against_all_pairs(spark):
    rng = random.Random(31)
    base = [prose(rng, rng.randint(12, 60)).replace("\n", " ").replace(".", "") for _ in range(40)]
    rows = []
    for k in range(400):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = prose(rng, 1).strip(".,\n ")
        rows.append((k, " ".join(words) + "."))
    rows += [(500, "two words."), (501, "two words."), (502, "Two words."), (503, "other words.")]
    sets = {k: frozenset(tuple(w[j : j + 5]) for w in [t.lower().split()] for j in range(max(1, len(w) - 4))) for k, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for x, b in enumerate(ids) for a in ids[:x] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for crowd in (paragraph_dedup.CROWD, 3):
        got = paragraph_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"), min_run=0, shortest=1, crowd=crowd).collect()
        cluster = {r["doc_id"]: r["cluster_id"] for r in got} | {r["kept_doc_id"]: r["cluster_id"] for r in got}
        found = sum(a in cluster and cluster.get(a) == cluster.get(b) for a, b in pairs)
        assert found >= 0.99 * len(pairs) > 300
        assert {501, 502} <= {r["doc_id"] for r in got} and 503 not in cluster
        root = list(range(600))
        for a, b in pairs:  # nothing is in a cluster but by links
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[b] = a
        top = lambda k: k if root[k] == k else top(root[k])
        assert all(top(r["doc_id"]) == top(r["kept_doc_id"]) for r in got)
    assert paragraph_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 500").count() == 0


def test_paragraph_forest_links_a_group_as_all_pairs_would():
    rng = np.random.default_rng(32)
    for _ in range(30):
        sets = []
        for _ in range(60):
            own = sets[rng.integers(len(sets))].copy() if sets and rng.random() < 0.7 else rng.integers(0, 10**6, rng.integers(1, 30)).astype(np.uint64)
            own[rng.integers(len(own))] = rng.integers(0, 10**6)
            sets.append(np.unique(own))
        root = list(range(60))
        top = lambda k, root: k if root[k] == k else top(root[k], root)
        for a in range(60):
            for b in range(a):
                if paragraph_dedup.similar(sets[a], sets[b]):
                    root[top(a, root)] = top(b, root)
        other = list(range(60))
        for a, b in paragraph_dedup.forest(list(range(60)), sets):
            assert paragraph_dedup.similar(sets[a], sets[b])
            other[top(a, other)] = top(b, other)
        assert len({top(k, root) for k in range(60)}) == len({top(k, other) for k in range(60)})


def contaminated(w, d):
    """Whether words ``w`` of an item are in a document's words ``d``: on one diagonal, in overlaps, or as a passage."""
    covered, longest = set(), 0
    for f in range(-len(w), len(d)):
        same = [k for k, x in enumerate(w) if 0 <= f + k < len(d) and d[f + k] == x]
        if len(same) >= 0.8 * len(w) > 0:
            return True
        overlaps = []
        for k in same:
            if overlaps and k - overlaps[-1][-1] <= 3:
                overlaps[-1].append(k)
            else:
                overlaps.append([k])
        for own in overlaps:
            if len(own) >= 5 and len(own) >= 0.8 * (own[-1] - own[0] + 1):
                covered |= set(own)
                longest = max(longest, len(own))
    return longest >= 50 or len(covered) >= 0.8 * len(w) > 0


def test_decontamination_verifies_around_hits(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    text = lambda n: [word() for _ in range(n)]
    long, plain, seven, six, huge = text(100), text(40), text(7), text(6), text(30_000)
    items = [(1, long), (2, plain), (3, seven), (4, six), (5, huge), (6, ["one"]), (None, text(20))]
    docs = [
        (1, text(30) + long[20:80] + text(30)), (2, text(30) + long[20:65] + text(30)),  # sixty words of a hundred; forty-five are no passage
        (3, text(9) + plain[:20] + ["inserted"] + plain[20:]), (4, text(9) + plain[:20] + plain[22:] + text(9)),
        (5, seven[:6]), (6, text(3) + six + text(3)), (7, six[:5] + text(2)), (8, ["a", "one", "b"]), (9, huge), (10, text(50)), (11, items[-1][1]), (12, ["x"] * 40_000),
    ]
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    for limit in (decon.BROADCAST_LIMIT, 3):
        got = {(r["doc_id"], r["item_id"]): r for r in decon.decontamination(*frames, broadcast_limit=limit).collect()}
        assert set(got) == {(1, 1), (3, 2), (4, 2), (5, 3), (6, 4), (7, 4), (8, 6), (9, 5), (11, None)}  # six words with one other, wherever, are found
        assert got[1, 1]["n_longest"] == 60 and got[3, 2]["n_matched"] == 40 and got[9, 5]["n_matched"] == 30_000


def test_decontamination_recall_under_substitutions(spark):
    rng = random.Random(14)
    items = [(k, prose(rng, n)) for k, n in enumerate(range(7, 57))]
    docs = []
    for share in range(0, 21, 5):
        for k, t in items:
            own = t.lower().split()
            for at in rng.sample(range(len(own)), len(own) * share // 100):
                own[at] = f"other{at}"
            docs.append((1000 * share + k, prose(rng, 20) + " " + " ".join(own) + " " + prose(rng, 20)))
    got = {(r["doc_id"], r["item_id"]) for r in decon.decontamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = {i: t.lower().split() for i, t in docs}
    want = {(i, j) for i, _ in docs for j, t in items if contaminated(t.lower().split(), words[i])}
    assert len(want) >= 250 and got <= want and len(got) >= 0.99 * len(want)


def test_decontamination_finds_every_allowed_substitution_in_short_items(spark):
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(1, 14)]
    docs, want = [], set()
    for n, own in items:
        allowed = n - math.ceil(0.8 * n - 1e-9)
        for gone in itertools.chain(*(itertools.combinations(range(n), k) for k in range(allowed + 2))):
            text = [f"other{k}" if k in gone else w for k, w in enumerate(own)]
            first = next((k for k in range(n) if k not in gone), n)
            # In the midst of a text; at its start without what was substituted there; at its end likewise.
            for body in (["a", "b", *text, "c"], text[first:], [*["x"] * 3, *text]):
                docs.append((len(docs), " ".join(body)))
                if len(gone) <= allowed:
                    want.add((docs[-1][0], n))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decon.decontamination(docs, bench).collect()} == want


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, 30)) for k in range(12)] + [(50, "too short here"), (51, None), (12, prose(rng, 25))]
    rows = []
    for k in range(40):
        words = prose(rng, 60).split()
        own = items[k % 12][1].upper().split()
        for at in rng.sample(range(len(own)), (k // 12) * 3):
            own[at] = f"other{at}"
        words[20:20] = own if k < 36 else own[:8]
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, ""), (102, items[12][1]), (102, items[12][1]), (None, items[12][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j) for i, t in rows for j, u in items if contaminated((u or "").lower().split(), (t or "").lower().split())}
    for limit in (decon.BROADCAST_LIMIT, 10):
        got = decon.decontamination(docs, bench, broadcast_limit=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {(k, k % 12) for k in range(24)} <= want and not any(i is not None and 36 <= i < 40 for i, _ in want)
    assert decon.decontamination(docs, bench.where("false")).count() == 0 == decon.decontamination(docs.where("false"), bench).count()


def test_clusters_of_near_copies_take_linear_time():
    import time

    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 63, 42, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(42)), rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for _ in range(20_000)]
    start = time.perf_counter()
    links = paragraph_dedup.forest(list(range(20_000)), sets)
    assert time.perf_counter() - start < 30 and len(links) >= 19_999
    parent = list(range(20_000))

    def find(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in links:
        parent[find(a)] = find(b)
    assert len({find(k) for k in range(20_000)}) == 1


def test_forest_connects_what_all_pairs_do():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pool = np.sort(rng.integers(0, 1 << 63, 14, dtype=np.uint64))
        sets = [np.sort(rng.choice(pool, rng.integers(4, 13), replace=False)) for _ in range(60)]

        def labels(links):
            group = list(range(60))
            for a, b in links:
                group = [group[a] if g == group[b] else g for g in group]
            return [group.index(g) for g in group]

        every = [(a, b) for a in range(60) for b in range(a) if paragraph_dedup.similar(sets[a], sets[b])]
        assert labels(paragraph_dedup.forest(list(range(60)), sets)) == labels(every)


def test_packing(corpus, awkward):
    from tokenizers import Tokenizer

    _, rows = corpus
    size = 256
    out = packing.best_fit_packing(awkward, size).collect()
    whole = Tokenizer.from_file(packing.tokenizer_files()[0])
    want = []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        for k, a in enumerate([0, *range(first, len(ids), size)]):
            b = first if not a else a + size
            want.append(str((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))))
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out) == sorted(want)
    full: dict = {}
    for r in out:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in full.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= size
    total = sum(r["length"] for r in out)
    assert len(full) <= -(-total // size) * 1.1 + 2


def greedy(lengths, size):
    """Item by item: large ones with the largest that fits, the others into the least gap."""
    large, bins = sorted((n for n in lengths if 3 * n > size), reverse=True), []
    while large:
        a = large.pop(0)
        b = next((x for x in large if x <= size - a), None)
        if b is not None:
            large.remove(b)
        bins.append([a] + [b] * (b is not None))
    for n in sorted((n for n in lengths if 3 * n <= size), reverse=True):
        fits = [b for b in bins if sum(b) + n <= size]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return bins


def test_plan_is_the_item_by_item_one():
    for seed in range(80):
        rng = random.Random(seed)
        size = rng.choice([10, 50, 300])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 200))]
        bins: dict = {}
        for n, lo, hi, s, _ in packing.plan_packing({n: lengths.count(n) for n in lengths}, size):
            for r in range(lo, hi):
                bins.setdefault(s + r - lo, []).append(n)
        assert sorted(map(sum, bins.values())) == sorted(map(sum, greedy(lengths, size)))  # equal gaps are ties


def test_long_white_space_is_tokenized():
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    encoder, whole = packing.Encoder(files), Tokenizer.from_file(files[0])
    for t in ("a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" * 300_000):
        assert encoder.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_is_the_tokenizers():
    from tokenizers import Tokenizer

    files = packing.tokenizer_files()
    encoder, whole = packing.Encoder(files), Tokenizer.from_file(files[0])
    odd = ["", "  a   b\n\n c ", "it's we'll\t\tx", "<|endoftext|> a", "日本 語 🙂", "é ñ ß\xa0x\x85y\x1c z", "".join(map(chr, range(1, 0x250))), "a" * 5000, "12 345,678"]
    assert all(encoder.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in odd)


def test_plan_packs_all():
    for seed in range(60):
        rng = random.Random(seed)
        size = rng.choice([10, 50, 2048])
        counts = {rng.randint(1, size): rng.randint(1, 40) for _ in range(rng.choice([1, 5, 60]))}
        bins, seen = {}, {}
        for n, lo, hi, s, o in packing.plan_packing(counts, size):
            seen.setdefault(n, []).extend(range(lo, hi))
            for r in range(lo, hi):
                bins.setdefault(s + r - lo, []).append((o, n))
        assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
        for own in bins.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= size
    assert packing.plan_packing({}) == []


def test_token_counts(corpus, awkward):
    pieces = token_counts.vocabulary(token_counts.vocabulary_file())
    known, longest = set(pieces), max(map(len, pieces))

    def brute(word):
        n = at = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known)
            n += 1
        return n

    want = sorted(str((i, len(w), len((t or "").encode()), sum(brute(b" " + x) for x in w))) for i, t in corpus[1] for w in [(t or "").encode().split()])
    assert sorted(str(tuple(r)) for r in token_counts.token_counts(awkward).collect()) == want
    with pytest.raises(ValueError):
        token_counts.LongestMatch([b"ab"])


def test_quality_rules(corpus, awkward):
    book = quality_rules.ledger(awkward).cache()
    for r in book.collect():
        t = next((t for i, t in corpus[1] if i == r["doc_id"]), None) or ""
        w = t.split()
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(covered)) and r["word_chars"] == sum(map(len, w))
        assert bool(r["failures"] & quality_rules.BASE) == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablations(book).collect()}
    assert found["few_words"][0] == book.where("n_words < 10").count() and all(a >= b for a, b in found.values())
    assert quality_rules.ablations(book.where("false")).count() == len(quality_rules.RULES)


def _accuracy(df, label, sf, spark, auc=False):
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    rows = df.where("held_out").join(marks, "doc_id").select("score", "predicted", label).collect()
    pos, neg = [r["score"] for r in rows if r[label]], [r["score"] for r in rows if not r[label]]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if auc else sum(r["predicted"] == r[label] for r in rows) / len(rows)


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.1"


def test_toxicity(spark, large, awkward):
    assert _accuracy(toxicity.op2_toxicity(spark, large), "toxic", large, spark, auc=True) > 0.93
    marks = spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(awkward, marks).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 and r["held_out"] == (crc_mod_py(r["doc_id"], 5) == 0) for r in out)
    assert toxicity.toxicity(awkward.where("false"), marks.where("false")).count() == 0


def test_quality_classifier(spark, large, awkward):
    assert _accuracy(quality_classifier.op9_quality_classifier(spark, large), "quality", large, spark) > 0.97
    marks = spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality_classifier(awkward, marks).collect()
    assert len(out) == awkward.count() and all(r["score"] == 0.5 for r in out)


def test_language_id(spark, large, awkward):
    docs = spark.read.parquet(f"{large}/documents.parquet")
    rows = lang.op6_language_id(spark, large).where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    out = {r["doc_id"]: r for r in lang.language_id(awkward).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0.0 for i in (201, 202, 203, 206)) and out[1]["lang_pred"] == "clash"
    kept = lang.determined(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    assert lang.language_id(awkward.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_empty_tables(spark, corpus):
    none = corpus[0].where("false")
    assert suffix_dedup.suffix_dedup(none).count() == 0 == simhash.simhash_components(none).count()
    assert paragraph_dedup.removals(none).count() == 0 == packing.best_fit_packing(none).count()
    assert token_counts.token_counts(none).count() == 0 == quality_rules.ledger(none).count()
    assert lang.language_id(none.withColumn("lang", F.lit("x"))).count() == 0


def test_very_long_text(spark):
    rng = random.Random(9)
    long = prose(rng, 60_000)
    df = spark.createDataFrame([(1, long), (2, "start#" + long[100_000:200_000])], "doc_id long, text string")
    r = {x["doc_id"]: x for x in suffix_dedup.suffix_dedup(df).collect()}
    assert r[1]["n_removed"] == 0 and r[2]["n_removed"] == len(long[100_000:200_000].encode())
    assert {x["doc_id"] for x in paragraph_dedup.removals(df).select("doc_id").collect()} == {2}
