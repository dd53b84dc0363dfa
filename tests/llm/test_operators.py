"""Each operator against a brute-force version on small tables with every awkward case."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import decontamination, embeddings, licenses, pieces, simhash, substrings, tokencounts, toxicity, urls, warc
from geoloom.llm._graph import components

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOREM = "Lorem ipsum Größe sit amet, consectetur adipiscing elit; sed do eiusmod tempor incididunt ut labore".split()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{LOREM[i]}{j}" for i, j in zip(rng.integers(0, len(LOREM), n), rng.integers(0, 40, n), strict=True))


def corpus():
    """Null, empty, blank, short, equal, near equal, very long and odd texts; ids from 0 with a gap."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "Changed", *words[61:]])
    passage = " ".join(prose(2, 50).split())
    texts = [
        None, "", "   \t\n", "one", "one two", "one two three", base, base, base.upper(), near, f"{prose(3, 40)} {passage} {prose(4, 30)}", f"{passage} {prose(5, 60)}", "a " * 200, "日本語 😀 ▁ \x00 ß", prose(6, 30_000),
        "x" * 50_000, f"{prose(7, 35)}", f"{prose(7, 35)}", f"{prose(7, 34)}", "MIT License. Released under the MIT License", "licensed under the Apache License, Version 2.0; CC BY-NC 4.0, cc by cc by", "gnu general public\tLICENSE",
    ]
    return [(100 + 3 * i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", "src", None if t is None else len(t), "kept") for i, t in corpus()]
    # Extra columns whose names clash with those that operators add.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3).cache()


def empty(df):
    return df.sparkSession.createDataFrame([], df.schema)


def test_substrings(docs):
    got = {r["doc_id"]: r for r in substrings.repeats(docs).collect()}
    words = {i: SPACED.findall(t or "") for i, t in corpus()}
    count = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        cover = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                cover[k : k + 35] = [True] * 35
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c)), i
        assert sum(s["end"] - s["first"] for s in got[i]["removed"]) == sum(cover)
        assert all(a["end"] < b["first"] for a, b in zip(got[i]["removed"], got[i]["removed"][1:], strict=False))
    assert substrings.repeats(empty(docs)).count() == 0
    cut = substrings.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[100] is None


def test_repeated_rows_are_documents_of_their_own(spark):
    text = prose(9, 40)
    rows = spark.createDataFrame([(1, text), (1, text), (None, prose(10, 40))], "doc_id long, text string")
    got = substrings.repeats(rows).select("doc_id", "n_removed").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, 0), (1, 40), (1, 40)]


def test_a_passage_in_every_document_stays_out_of_buckets(monkeypatch):
    """One passage in 2,000 documents of a block each: its buckets get one entry a flush, not one a document."""
    import types

    import pyarrow as pa

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: types.SimpleNamespace(partitionId=lambda: 3))
    passage = prose(2, 60)
    texts = [f"{prose(10 + i, 40)} {passage}" for i in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2_000), pa.int32()), pa.array(texts)], ["b", "text"])
    sent = pa.Table.from_batches(substrings._send(35, 16)([batch]))
    n = sum(len(x) // 8 for x in sent.filter(pa.compute.invert(sent.column("known"))).column("hashes").to_pylist())
    seen = collections.Counter(" ".join(t.split()[i : i + 35]) for t in texts for i in range(len(t.split()) - 34))
    repeated = sum(k for k in seen.values() if k > 1)
    assert n == len(seen) and repeated >= 2_000 * 26
    known = sent.filter(sent.column("known"))
    assert sum(len(x) // 8 for x in known.column("hashes").to_pylist()) == repeated and len(set(known.column("bucket").to_pylist())) > 8
    found = substrings._repeated(sent)
    assert sum(len(x) // 8 for x in found.column("found").to_pylist()) == repeated


def fingerprint(text):
    w = SPACED.findall(low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = [(i, t) for i, t in corpus()]
    f = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i in f}
    for _ in range(len(f)):
        for a in f:
            for b in f:
                if bin(f[a] ^ f[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["fingerprint"] % 2**64 for i, r in got.items()} == f
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert simhash.near_duplicates(empty(docs)).count() == 0
    lone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in lone) == [(0, 0), (5, 5), (5, 5)]


def test_long_texts_in_pieces(monkeypatch):
    """Fingerprints, features and hashes are those of the whole text, however it is cut."""
    from geoloom.llm import _words as W

    rng = np.random.default_rng(4)
    for text in (prose(9, 3_000), "ab " * 4_000, "x" * 9_000 + " y " + "Ü😀 " * 900, "one", " \n" * 3_000, "x" * 9_000, " ".join("w" * int(n) for n in rng.integers(1, 400, 200))):
        data = np.frombuffer(text.encode(), np.uint8)
        rows = np.array([0, len(data)])
        whole = simhash._fingerprints(data, rows, 3), toxicity._pairs(data, rows, None)[1], W.split(data, rows, "spaced", True).hashes()
        with monkeypatch.context() as m:
            m.setattr(simhash, "_LONG", 1_000)
            m.setattr(toxicity, "_LONG", 700)
            m.setattr(W, "CHUNK_BYTES", 512)
            m.setattr(W, "_powers", {})
            parts = simhash._fingerprints(data, rows, 3), toxicity._pairs(data, rows, None)[1], W.split(data, rows, "spaced", True).hashes()
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
        assert whole[0][0] == fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_vantage_point_tree_finds_all(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(300)])
    x = np.unique(np.concatenate([base, base ^ flips, base[:50] ^ np.uint64(1)]))
    found = set()
    for a, b in simhash.VPTree(x, leaf=8).pairs(x, radius):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert found == {(a, b) for a in range(len(x)) for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= radius).tolist()}


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 1_500, dtype=np.int64)
    near = base ^ (1 << rng.integers(0, 62, 1_500)) ^ (1 << rng.integers(0, 62, 1_500))
    x = np.unique(np.concatenate([base, near]))
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in x], "f long"), shard_rows=64)
    comp = {r["node"]: r["component"] for r in components(edges).collect()}
    for a, b in zip(base.tolist(), near.tolist(), strict=True):
        assert a == b or comp[a] == comp[b]


def test_similar_keeps_one_of_each_group(spark):
    texts = {}
    for g in range(12):
        w = prose(50 + g, 200).split()
        texts[10 * g] = " ".join(w)
        texts[10 * g + 1] = " ".join(w)
        texts[10 * g + 2] = " ".join([*w[:90], "other", *w[91:]])
    texts[500], texts[501] = prose(99, 150), None
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, _gone string")
    left = simhash.keep_one(rows)
    assert left.columns == rows.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([*range(0, 120, 10), 500, 501])
    assert simhash.keep_one(empty(rows)).count() == 0


def jaccard_groups(texts, similarity=0.8):
    """The smallest id of each text's group, by the exact similarity of all pairs."""
    words = {i: SPACED.findall(low(t)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in texts}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if root[a] != root[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                low_, high = sorted((root[a], root[b]))
                root = {i: low_ if r == high else r for i, r in root.items()}
    return root


def test_similar_is_exact_on_both_sides_of_the_threshold(spark):
    texts = {}
    for g in range(60):
        w = [f"{x}{g}" for x in prose(200 + g, 1_000).split()]
        texts[2 * g] = " ".join(w)
        for k in range(22 + g % 2):  # similarities 0.801 and 0.793
            w[20 + 40 * k] = f"new{k}"
        texts[2 * g + 1] = " ".join(w)
    root = jaccard_groups(texts)
    assert sum(i != r for i, r in root.items()) == 30
    left = simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, r in root.items() if i == r)


def test_similar_gives_up_no_pair_of_a_templated_group(spark, monkeypatch):
    template = prose(300, 430).split()
    texts = {}
    for g in range(200):
        w = template + [f"{x}{g}" for x in prose(301 + g, 70).split()]
        texts[g] = " ".join(w)
        if g % 2:
            for k in range(10):
                w[5 + 40 * k] = f"new{k}of{g}"
            texts[1_000 + g] = " ".join(w)
    root = jaccard_groups(texts)
    assert sum(i != r for i, r in root.items()) == 100 and len(set(root.values())) == 200
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (simhash._BLOCK, 30_000):  # all in one block, and dealt to several
        monkeypatch.setattr(simhash, "_BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar(rows).collect()}
        assert {i: got.get(i, i) for i in texts} == root


def test_alike_links_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    link = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets]
    for asked in (80, 30):
        root = list(range(80))
        for _ in range(80):
            for a in range(asked):
                for b in range(a + 1 if asked == 80 else asked, 80):
                    if link[a][b]:
                        root[a] = root[b] = min(root[a], root[b])
        assert simhash.alike(sets, asked, 0.8).tolist() == root


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + i) for i in range(1, 300)] + [(2_000 + i, 2_000 + (i + 1) % 50) for i in range(50)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1_000 + i: 1_000 for i in range(300)}, **{2_000 + i: 2_000 for i in range(50)}}


def contaminated(texts, items, window=10):
    win = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            win[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in texts:
        w, hit, ids = ALNUM.findall(low(t)), set(), set()
        for n in {len(k) for k in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    ids |= win[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(str(i) for i in ids if i is not None))
    return out


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 200])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = [(1, " ".join(prose(6, 30_000).split()[100:140])), (2, "one TWO"), (10, " ".join(prose(2, 50).split()[:30])), (None, " ".join(prose(5, 60).split()[:20])), (4, None), (5, ""), (2, prose(77, 30)), (7, "a a a a a a a a a a a a")]
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = contaminated(corpus(), items)
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in got.items()} == want
    for r in got.values():
        assert len({p for m in r["matches"] for p in range(m["first"], m["end"])}) == r["n_hit"]


def test_suffix_array_is_sorted_and_matches_are_longest():
    from geoloom.llm import _words as W

    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], int(n))) for n in rng.integers(0, 60, 30)]
    items = [(str(i), " ".join(rng.choice(["a", "b", "c", "d"], int(n)))) for i, n in enumerate(rng.integers(1, 30, 40))] + [("long", texts[3] + " e " + texts[5]), ("same", texts[3])]
    w = W.split(*W.buffers(__import__("pyarrow").array(texts)), "alnum", True)
    block = decontamination.Block.of(items)
    array = decontamination.SuffixArray(w, 130)
    assert sorted(array.order.tolist()) == list(range(len(w) + len(texts)))
    tails = []
    for x in array.order.tolist():
        end = x + int(np.flatnonzero(array.text[x:] == 0)[0])
        tails.append(array.text[x:end].tolist())
    assert tails == sorted(tails)
    row, first, end, suffix, of_row, item = decontamination._search(array, block, 4)
    got = {(int(r), int(f)): int(e - f) for r, f, e in zip(row, first, end, strict=True)}
    want, named = {}, set()
    for r, t in enumerate(texts):
        a = t.split()
        for i in range(len(a)):
            for k, (_, u) in enumerate(items):
                b = u.split()
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= min(4, len(b)) and len(b) - j >= min(4, len(b)):
                        want[r, i] = max(want.get((r, i), 0), n)
                        named.add((r, k))
    assert got == want and set(zip(of_row.tolist(), item.tolist(), strict=True)) == named


def test_decontamination_without_items_or_documents(spark, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, items).where("n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, " ".join(prose(2, 50).split()[:30]))], "item_id long, text string")
    assert decontamination.contamination(empty(docs), some).count() == 0
    clean = decontamination.decontaminate(docs, some)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert {r["n_words"] for r in clean.collect()} == {"kept"}


def test_pieces_round_trip_and_repeat(spark, docs):
    one = pieces.encode(docs, verify=True)
    got = {r["doc_id"]: r for r in one.collect()}
    for i, t in corpus():
        assert got[i]["decoded"] == t
        assert (got[i]["token_ids"] is None) == (t is None) and (t != "" or got[i]["token_ids"] == [])
        assert got[i]["n_tokens"] == len(got[i]["token_ids"] or [])
    again = {r["doc_id"]: r["token_ids"] for r in pieces.encode(docs.repartition(7)).collect()}
    assert again == {i: r["token_ids"] for i, r in got.items()}
    other = {r["doc_id"]: r["token_ids"] for r in pieces.encode(docs, seed=1).collect()}
    assert sum(other[i] != again[i] for i in again) > 10
    back = pieces.decode(one.select("doc_id", "token_ids"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(corpus())
    assert pieces.encode(empty(docs)).count() == 0


def test_pieces_follow_the_lattice(spark, monkeypatch):
    """Frequencies of sampled segmentations against the weights of all paths."""
    p = pieces.Pieces()
    word = b" there"
    log = {p.bytes[i]: None for i in range(len(p.bytes))}
    for node in np.flatnonzero(p.piece >= 0):
        log[p.bytes[p.piece[node]]] = p.log[node]
    paths = {}

    def walk(at, ids, weight):
        if at == len(word):
            paths[tuple(ids)] = np.exp(weight)
        for end in range(at + 1, len(word) + 1):
            if log.get(word[at:end]) is not None:
                walk(end, [*ids, p.bytes.index(word[at:end])], weight + log[word[at:end]])

    walk(0, [], 0.0)
    n = 20_000
    with monkeypatch.context() as m:  # a part that is filtered alone, in blocks that no piece keeps to
        m.setattr(pieces, "_BLOCK", 2)
        of = np.frombuffer(word, np.uint8)
        alone = collections.Counter(tuple(pieces._long(p, of, np.uint64(7919 * i + 1), 1.0).tolist()) for i in range(n))
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("there").alias("text"))
    seen = collections.Counter(tuple(r[0]) for r in pieces.encode(rows).select("token_ids").collect())
    total = sum(paths.values())
    for found in (seen, alone):
        assert set(found) <= set(paths)
        for ids, w in paths.items():
            share = w / total
            assert abs(found[ids] / n - share) < 5 * np.sqrt(share / n) + 1e-3


@pytest.mark.parametrize("alpha", [0.0, 1.0, 8.0])
def test_pieces_of_texts_without_spaces(spark, alpha):
    rng = np.random.default_rng(2)
    cjk = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 70_000)))
    odd = "".join(rng.choice(list("aé漢😀\x00▁the\n"), 30_000))
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate([(cjk, "x"), ("a", odd), ("a" * 200_000, " " * 100), (odd[:4_096], odd[:4_097])])]
    df = spark.createDataFrame([*rows, *rows[:1], (None, cjk)], "doc_id long, text string")
    out = pieces.encode(df, alpha=alpha, verify=True).collect()
    assert len(out) == 6 and all(r["decoded"] == r["text"] for r in out)
    p, data = pieces.Pieces(), np.frombuffer((prose(5, 4_000) + cjk[:5_000]).encode(), np.uint8)
    whole = pieces._encode(p, data, np.array([0, len(data)]), np.array([3], np.uint64), alpha, 0)
    with pytest.MonkeyPatch.context() as m:  # a row in many groups of parts gets the same pieces
        m.setattr(pieces, "_CHUNK", 1_000)
        parts = pieces._encode(p, data, np.array([0, len(data)]), np.array([3], np.uint64), alpha, 0)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    one, two = (r["token_ids"] for r in out if r["doc_id"] == 0)
    assert one == two and one != next(r["token_ids"] for r in out if r["doc_id"] is None)


def test_token_counts(spark, docs, tmp_path):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=tokencounts._ranks(tokencounts.RANKS), special_tokens={})
    for size in (7, 1 << 18):
        got = dict(tokencounts.counts(docs, f"file://{tmp_path}/tokens{size}", block_tokens=size).collect())
        assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in corpus()}
    assert tokencounts.counts(empty(docs), f"file://{tmp_path}/none").count() == 0


def test_tokens_of_long_runs(spark, tmp_path):
    """Parts give the same tokens as the whole text; white space of 2 MB, on which the pattern fails, is encoded."""
    import tiktoken

    ranks = tokencounts._ranks(tokencounts.RANKS)
    plain = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = tokencounts.encoder(ranks, run=3, part=5)
    rng = np.random.default_rng(3)
    for n in range(300):
        text = "".join(rng.choice(list("ab1 \n\t\u3000\x85\x1c'.s") + ["  ", "    ", "\n\n\n", "'s", "ü"], n % 40))
        assert [t for part in small(text) for t in part] == plain.encode_ordinary(text)
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 2_000_000 + "b"), (None, "x y"), (None, "x y"), (3, None)]
    got = tokencounts.counts(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/t", file_tokens=1_000, width=4).collect()
    want = {1: len(plain._encode_single_piece(" " * 2_000_000)), 2: len(plain._encode_single_piece("\n" * 1_999_999)) + 3, 3: 0}
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"]} == want and sum(r["doc_id"] is None and r["n_tokens"] == 2 for r in got) == 2


def test_flat_files_of_other_writers(spark, tmp_path):
    flat = np.array([5, 9, 9, 4, 4, 4, 9, 2], "<u2")
    (tmp_path / "sub").mkdir()
    flat.tofile(tmp_path / "sub" / "a.bin")
    flat[:2].tofile(tmp_path / "b.bin")
    got = tokencounts.scan(tokencounts.blocks(spark, f"file://{tmp_path}", block_tokens=3), separator=9).collect()
    assert sorted((r["file"][-5:], r["ordinal"], r["n_tokens"], r["closed"]) for r in got) == [("a.bin", 0, 1, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 1, False), ("b.bin", 0, 1, True)]
    (tmp_path / "c.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        tokencounts.blocks(spark, f"file://{tmp_path}").count()


def test_separator_scan_stitches_blocks(spark):
    flat = [9, 9, 1, 1, 9, 2, 2, 2, 2, 2, 9, 3]
    rows = [(0, b, np.array(flat[4 * b : 4 * b + 4], "<u2").tobytes()) for b in range(3)] + [(1, 0, b""), (2, 0, None), (3, 0, np.array([9], "<u2").tobytes())]
    got = tokencounts.scan(spark.createDataFrame(rows, "file int, block long, tokens binary"), separator=9).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, True), (0, 1, 0, True), (0, 2, 2, True), (0, 3, 5, True), (0, 4, 1, False), (3, 0, 0, True)]


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, t in corpus():
        w = ALNUM.findall(low(t))
        places = [(k, p.label) for p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.words)] == p.words]
        r = got[i]
        starts = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), i
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        labels = {x for _, x in places}
        score = float(bool(places))
        for p in licenses.TEMPLATES:
            text, key = p.words, p.key.split()
            off = next(k for k in range(len(text)) if text[k : k + len(key)] == key)
            for k in range(-len(text), len(w)):
                agree = sum(0 <= k + j < len(w) and w[k + j] == text[j] for j in range(len(text))) / len(text)
                if k + off >= 0 and w[k + off : k + off + len(key)] == key and agree >= 0.8:
                    labels.add(p.label)
                    score = max(score, agree)
        assert r["labels"] == ",".join(sorted(labels)) and r["score"] == pytest.approx(score), i
    assert "apache-2.0" in got[160]["labels"] and "mit" in got[157]["labels"]
    assert licenses.scan(empty(docs)).count() == 0


def test_whole_licence_texts(spark):
    """Each text is found under its own label, alone and with words changed inside others; half of it is not."""
    rows = []
    for i, t in enumerate(licenses.TEXTS):
        w = t.text.split()
        changed = [x if k % 40 != 39 or x.lower().strip(".,") in t.key else "changed" for k, x in enumerate(w)]
        rows += [(i, t.text), (100 + i, f"{prose(i, 50)} {' '.join(changed).upper()} {prose(i, 20)}"), (200 + i, " ".join(w[: len(w) // 3]))]
    df = spark.createDataFrame([*rows, (None, licenses.TEXTS[0].text), (None, licenses.TEXTS[0].text), (300, "the of software " * 100_000)], "doc_id long, text string")
    out = licenses.scan(df).collect()
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    for i, t in enumerate(licenses.TEXTS):
        assert t.label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, t.label
        assert t.label in got[100 + i]["labels"].split(","), t.label
        assert not any(x["share"] < 0.8 for x in got[200 + i]["spans"])
    assert got[300]["labels"] == "" and [r["labels"] for r in out if r["doc_id"] is None] == [got[0]["labels"]] * 2


def test_urls(spark):
    cases = {
        "http://Shop.EXAMPLE.com/en/1?x": ("shop.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/2": ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), "http://x.com/": ("x.com", "/", "com/", "allow"), "http://x.com": ("x.com", "", None, None),
        "http://com/a": ("com", "/a", "com/", "allow"), "http://telecom/a": ("telecom", "/a", None, None), "ftp://a.net/fr/b#c": ("a.net", "/fr/b", "net/fr/", "block"), "a.com/b": ("", "", None, None),
        None: ("", "", None, None), "": ("", "", None, None), "http://": ("", "", None, None), "x://ÄB.Net?q=/es/": ("Äb.net", "", None, None),
    }
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id long, url string, _s string")
    got = {r["url"]: r for r in urls.judge(rows).collect()}
    for u, (host, path, rule, verdict) in cases.items():
        assert (got[u]["host"], got[u]["path"], got[u]["rule"], got[u]["_s"]) == (host, path, rule, "mine"), u
        assert got[u]["verdict"] in (verdict,) if verdict else got[u]["verdict"] in ("allow", "block")
    assert urls.judge(empty(rows)).count() == 0


@pytest.mark.parametrize("rows", [0, 3, 50])
def test_urls_beyond_broadcasts(spark, monkeypatch, rows):
    """However few n-grams may be broadcast, the scores are the same."""
    pages = spark.createDataFrame([(i, f"https://h{i % 7}.{'com' if i % 3 else 'net'}/{'es' if i % 2 else 'xy'}/{i}") for i in range(120)] + [(None, None), (5, "u"), (5, "u")], "page_id long, url string")
    want = sorted(map(str, urls.judge(pages).collect()))
    monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)
    assert sorted(map(str, urls.judge(pages).collect())) == want


def test_url_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdegh"), rng.integers(2, 6)))
    made = [f"http://{word()}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'es', 'x'])}/{word()}" for _ in range(120)]
    made += made[:10]
    got = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")).collect()
    count = {v: [collections.Counter() for _ in range(4)] for v in ("allow", "block")}
    text = lambda r: urls.BEGIN + r["host"] + r["path"] + urls.END
    held = lambda s: hashlib.md5(s.encode()).hexdigest()[0] in "012"
    for r in got:
        if r["rule"] and not held(text(r)):
            s = text(r)
            for i in range(1, len(s)):
                for k in range(min(i, 3) + 1):
                    count[r["verdict"]][k][s[i - k : i + 1]] += 1

    def log_p(v, others, c):
        p = 1 / 256
        for k in range(len(others) + 1):
            context = others[len(others) - k :]
            after = {g: n for g, n in count[v][k].items() if g[:-1] == context}
            n, t = sum(after.values()), len(after)
            p = (after.get(context + c, 0) + t * p) / (n + t) if n else p
        return np.log(p)

    for r in got:
        if r["rule"] is None:
            s = text(r)
            score = sum(log_p("allow", s[max(0, i - 3) : i], s[i]) - log_p("block", s[max(0, i - 3) : i], s[i]) for i in range(1, len(s))) / (len(s) - 1)
            assert r["score"] == pytest.approx(score, abs=1e-8)
        else:
            assert r["score"] is None


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>ü</p>" * 200, "x" * 1_000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "", None), (6, "u", ""), (7, "u", other), (7, "v", other), (None, "n", other), (8, "w", "y" * 3_000_000), (None, "q", "z" * 2_000)]
    path = f"file://{tmp_path}/warc"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = sorted(((r["page_id"] or -1, r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read(spark, path).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    lead = {big: 9, other: 7}
    want = []
    for i, u, t in rows:
        revisit = t in lead and i != lead[t]
        want.append((i or -1, u or None, "revisit" if revisit else "response", len((t or "").encode()), sha(t), lead[t] if revisit else None))
    assert got == sorted(want, key=str)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_keeps_any_url_and_splits_archives(spark, tmp_path):
    urls_ = ["http://a/\r\n\r\nb", "http://a/\r\nX: y", "  http://b ", "http://c/%20\x85\u3000", "http://d/ü", "\x00", "WARC/1.1"]
    rows = [(i, u, "p" * (900 + i), "clash", "clash") for i, u in enumerate(urls_)] + [(100 + i, "u", str(np.random.default_rng(i).integers(0, 10**9, 400).tolist()), None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, kind string").repartition(2)
    path = f"file://{tmp_path}/warc"
    warc.write(df, path, archive_bytes=5_000)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert {i: r["url"] for i, r in got.items()} == {i: u for i, u, *_ in rows} and all(got[i]["payload"] == h for i, _, h, *_ in rows)
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*") if f.stat().st_size]
    assert len(sizes) > 3 and max(sizes) <= 5_000 + 32_768 + 16
    again = spark.createDataFrame([(1, "response", "d", None), (2, "revisit", "d", 1), (3, "revisit", "e", 1), (4, "revisit", "d", 9)], "page_id long, record_type string, payload_digest string, refers_to long")
    assert {r["page_id"] for r in warc.dangling(again).collect()} == {3, 4}


def test_warc_sends_the_driver_its_sample_only(spark):
    """40 tasks with 50 payloads of 60 KB each: 117 MB, of which the sample is 3 MB at most."""
    pages = spark.range(0, 2_000, numPartitions=40).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), 1_900).alias("html"))
    sizes = [len(x) for x in warc._sample(pages, 50)]
    assert len(sizes) == 50 and sum(sizes) < 50 * 65_536


def test_warc_rejects_broken_archives():
    import zstandard

    dictionary = warc.train([(b"<html><body>%d" % i) * 30 for i in range(200)], 4_096)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    raw = warc.record("response", "http://a", 1, hashlib.sha1(b"hello").hexdigest(), b"hello", 5)
    good = warc.skippable(dictionary) + packer.compress(raw) + warc.EMPTY + packer.compress(raw)
    assert [warc.parse(r)["payload"] for r in warc.frames(good)] == [b"hello"] * 2
    for bad in (good[:-3], good[: len(good) // 2], warc.skippable(b"") + good, good[:40]):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(bad))
    for old, new in ((b"WARC/1.1", b"WORC/1.1"), (b"hello", b"hallo"), (b"\r\n\r\nhello", b"\r\n\r\nhell"), (b"WARC-Date", b"WARC-Dat"), (b"urn:page:1", b"urn:pag:1"), (b"Content-Length: 5", b"Content-Length: 6")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(raw.replace(old, new))


def vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 16))
    rows = [[float(v) for v in r] for r in x]
    rows += [[float(v) for v in r + 0.05 * rng.standard_normal(16)] for r in x[:20]]
    core = rng.standard_normal(16)
    rows += [[float(v) for v in core + 0.2 * rng.standard_normal(16)] for _ in range(150)]
    rows += [rows[0], rows[0], [2 * v for v in rows[1]]]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [1e-300] * 16]
    return rows


def test_embeddings(spark):
    rows = vectors()
    df = spark.createDataFrame([(7 * i + 5, v, 1, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, n_links string").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, window=8).collect()}
    unit = {}
    for i, v in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            u = np.array(v) / np.abs(v).max()
            unit[7 * i + 5] = u / np.linalg.norm(u)
    links = {a: {b for b in unit if b != a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9} for a in unit}
    root = {7 * i + 5: 7 * i + 5 for i in range(len(rows))}
    for _ in range(20):
        for a, near in links.items():
            for b in near:
                root[a] = root[b] = min(root[a], root[b])
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(links.get(i, ())), c, c == i) for i, c in root.items()}
    assert embeddings.near_duplicates(empty(df)).count() == 0
    odd = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in odd) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]


def test_embeddings_of_a_loose_hot_cluster(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal(64) + 0.6 * rng.standard_normal((2_000, 64))  # cosines of about 0.74
    x = np.concatenate([x, x[:200] + 0.42 * rng.standard_normal((200, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[:200, 2_000:].sum() > 100
    monkeypatch.setattr(embeddings, "BLOCK", 100)
    monkeypatch.setattr(embeddings, "SMALL", 8)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert all(got[a]["component_id"] == got[b]["component_id"] for a, b in np.argwhere(near).tolist())


@pytest.mark.parametrize("partitions", [1, 40])
def test_embeddings_recall_at_the_threshold(spark, partitions):
    """2,000 pairs of cosine 0.901 among 20,000 vectors; with 40 partitions, windows reach over several borders."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.standard_normal((20_000 // partitions, 64)))
    k = 2_000 // partitions
    z = rng.standard_normal((k, 64))
    z = unit(z - (z * x[:k]).sum(1)[:, None] * x[:k])
    x = np.concatenate([x, 0.901 * x[:k] + np.sqrt(1 - 0.901**2) * z])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 1)
        spark.conf.set("spark.sql.shuffle.partitions", max(4, partitions))
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = len(x) - k
    assert sum(got[n + i]["component_id"] == i and got[n + i]["n_links"] == 1 for i in range(k)) >= 0.99 * k
    assert sum(r["n_links"] for r in got.values()) <= 2 * k


def test_embeddings_count_passes_by_density():
    p = embeddings.agreement(0.9)
    assert 0.4 < p < 0.5 and embeddings.passes_needed(np.zeros(9, int), p, 1e-3) == 1
    few, many = (embeddings.passes_needed(np.array(d), p, 1e-3) for d in ([0, 90, 10], [0, 10, 80, 10]))
    assert few < many and (1 - p) ** few <= 1e-3


def test_toxicity_learns_from_its_rows_only(spark):
    bad = ["nasty", "vile", "rotten"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = prose(1_000 + i, 30).split()
        if toxic:
            w[i % 25] = bad[i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(toxic)))
    rows += [(2_000, None), (2_001, ""), (2_002, "vile " * 5_000), (None, "nasty")]
    labels += [(1, 1, None), (None, 0, 1)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, df)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"] and r["doc_id"] < 1_000]
    assert len(held) > 200 and sum((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[2_000] == by[2_001] < 0.5 < by[2_002] and by[None] > 0.5
    # Labels of held-out rows change nothing.
    turned = df.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.fit(docs, turned)
    assert np.array_equal(model.features, same.features) and np.allclose(model.weights, same.weights)
    assert toxicity.drop_toxic(docs, df).columns == docs.columns
    nothing = toxicity.fit(docs, empty(df))
    assert len(nothing.features) == 0 and toxicity.score(empty(docs), nothing).count() == 0


def grams(text):
    """The distinct hashed character n-grams of a text, one at a time."""
    chars = [ord(c) for c in low(text)]
    out = set()
    for k in toxicity.SIZES:
        for i in range(len(chars) - k + 1):
            h = 0
            for c in chars[i : i + k]:
                h = (h * 0x01000193 + c * 0x9E3779B1) & 0xFFFFFFFF
            x = ((h ^ (h >> 15)) * 0x85EBCA6B + (k * 0x27D4EB2F & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.add(x >> (32 - toxicity.BITS))
    return out


def test_toxicity_against_brute_force(spark):
    """Ratios, chosen features, coefficients and scores by plain loops over a small table."""
    texts = [(i, f"{prose(3_000 + i, 12)} {'vile ßad' if i % 4 == 0 else 'fine 😀'}") for i in range(60)]
    y = {i: int(i % 4 == 0 or i == 7) for i, _ in texts}
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(list(y.items()), "doc_id long, toxic int"), max_features=40)
    known = [(i, grams(t)) for i, t in texts if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    pos, neg = sum(y[i] for i, _ in known), sum(1 - y[i] for i, _ in known)
    seen = {}
    for i, g in known:
        for f in g:
            seen.setdefault(f, [0, 0])[1 - y[i]] += 1

    def gain(a, b):
        cells = [(a, pos, a + b), (b, neg, a + b), (pos - a, pos, pos + neg - a - b), (neg - b, neg, pos + neg - a - b)]
        return sum(x * np.log(x / (of * among / (pos + neg))) for x, of, among in cells if x)

    top = sorted((-round(gain(a, b), 9), f) for f, (a, b) in seen.items() if a + b >= 3)[:40]
    least = -top[-1][0]
    assert set(f for g, f in top if -g > least + 1e-6) <= set(model.features.tolist()) and len(model.features) == 40
    ratio = {f: np.log((seen[f][0] + 0.5) / (pos + 1)) - np.log((seen[f][1] + 0.5) / (neg + 1)) for f in model.features.tolist()}
    coefficient = np.array([w / ratio[f] if ratio[f] else 0.0 for f, w in zip(model.features.tolist(), model.weights, strict=True)])
    x = np.array([[ratio[f] * (f in g) for f in model.features.tolist()] for _, g in known])
    t = np.array([y[i] for i, _ in known])
    p = 1 / (1 + np.exp(-(x @ coefficient + model.bias)))
    # At the minimum of the penalised loss its gradient is zero.
    assert np.abs(x.T @ (p - t) + coefficient).max() < 0.05 and abs((p - t).sum()) < 0.05
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in texts:
        z = model.bias + sum(w for f, w in zip(model.features.tolist(), model.weights, strict=True) if f in grams(text))
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_odd_rows_of_text_operators(spark, tmp_path):
    """Null ids, repeated rows, empty tables, and columns named like those that operators add."""
    rows = [(None, "gnu general public license"), (None, None), (1, prose(1, 30)), (1, prose(1, 30)), (2, ""), (2, " "), (3, prose(1, 30))]
    names = ["token_ids", "decoded", "n_tokens", "fingerprint", "component_id", "matches", "items", "n_hit", "score", "spans", "labels", "removed", "kept"]
    df = spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(names))]) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(2)
    none, items = df.limit(0), spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (None, "gnu general public license")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    operators = {
        "licenses": lambda d: licenses.scan(d), "pieces": lambda d: pieces.encode(d, verify=True), "tokens": lambda d: tokencounts.counts(d, f"file://{tmp_path}/{d.count()}"),
        "substrings": lambda d: substrings.repeats(d), "simhash": lambda d: simhash.near_duplicates(d), "benchmark": lambda d: decontamination.contamination(d, items), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
    }
    for name, run in operators.items():
        out = run(df).collect()
        assert len(out) == len(rows) and sum(r["doc_id"] is None for r in out) == 2, name
        assert run(none).count() == 0, name
        same = [tuple(r[c] for c in r.asDict() if c not in names or c in ("token_ids", "items")) for r in out if r["doc_id"] == 1]
        assert len(same) == 2 and str(same[0]) == str(same[1]), name
    found = {r["doc_id"]: r for r in decontamination.contamination(df, items).collect()}
    assert found[3]["items"] == ["1"] and found[3]["n_hit"] == found[3]["n_words"] > 30 and found[None]["items"] == []
