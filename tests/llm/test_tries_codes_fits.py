"""The prefix trie, vector codes and first-fit packing against brute force, on rows that are odd in every way."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom_llm_rows import make
from marketloom.llm import first_fit, prefix_trie, vector_codes
from marketloom.llm.word_ids import WordEnds

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, block int, own string, sequence int, words string, part int, node string, kind string"


def brute_trie(rows):
    """Nodes of the rebuilt conversations, by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [t[2] for t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        source = c - int(math.fmod(c, 20))
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(source, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p, *(q for c in children[p] for q in below(c))]

    out = Counter()
    for p, m in members.items():
        nodes = below(p)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in nodes if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in nodes), saved, digest] += 1
    return out


def odd_turns():
    rng = random.Random(5)
    rows = []
    for c in [*range(-45, -39), *range(130), 140, 161, 178, 10**12, 10**12 + 1]:
        if c % 11 == 3:
            continue
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            text = rng.choice(["a b", "a  b\n c", "", None, "x" * 3000, "ñ 漢字\x85 ", "same words here", f"own {c}"])
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), text))
    for c in range(200, 260):  # copies, and chains of prefixes of each other
        rows += [(c, t, "user", "copied turn") for t in range(3 + c % 3)]
    rows += [(300, t, "user", f"turn {t}") for t in range(250)]  # a long one
    rows += [(301, None, "user", "null turn"), (301, None, "user", "null turn"), (301, 0, "user", "b"), (301, 0, "user", "a"), (None, 0, "user", "no id"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_in_part", [2, 7, 40, 20_000])
def test_prefix_trie(spark, rows_in_part):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, *[None] * 7) for r in rows], TURNS).repartition(3)
    found = prefix_trie.trie(prefix_trie.rebuilt(turns), rows=rows_in_part)
    assert Counter(map(tuple, found.collect())) == brute_trie(rows)


def test_prefix_trie_in_small_pieces(spark, monkeypatch):
    """Ids that end on a border in pieces, and parents joined by partition."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 2)
    monkeypatch.setattr(prefix_trie, "SENT_PARENTS", 0)
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, *[None] * 7) for r in rows], TURNS)
    assert Counter(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(turns), rows=9).collect())) == brute_trie(rows)
    empty = turns.where("false")
    assert prefix_trie.conversation_trie(empty).collect() == []
    # one conversation that has no turns left: only the root
    lost = spark.createDataFrame([(1, 0, "user", "a")] if zlib.crc32(b"1") % 4 else [(2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    (root,) = prefix_trie.conversation_trie(lost).collect()
    assert (root["depth"], root["n_convs"], root["n_leaves"], root["parent_conv_id"]) == (0, 1, 1, None)


def test_range_minimum_and_common_turns():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 50, n)
        least = prefix_trie.RangeMinimum(values)
        for _ in range(50):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a + 1, n + 1))
            assert least.least(np.array([a]), np.array([b]))[0] == values[a:b].min()
    rows = [[], [1], [1], [1, 2], [1, 2, 3], [2], [2, 1, 1]]
    flat = np.array([x for r in rows for x in r], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert prefix_trie.common_turns(offsets, np.stack([flat, flat], axis=1)).tolist() == [0, 0, 1, 1, 2, 0, 1]


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ints = [[math.floor(np.float32(c) * 256.0) for c in v] for _, v, _ in kept]
    p = len(ints[0]) // parts
    cut = [[tuple(x[m * p : (m + 1) * p]) for m in range(parts)] for x in ints]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    ids += [None] * (len(ids) < entries and any(i is None for i, _, _ in kept))
    first = [min((v, k) for k, (i, v, _) in enumerate(kept) if i == own)[1] for own in ids]
    books = [[cut[k][m] for k in first] for m in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for m in range(parts):
            own = defaultdict(list)
            for x in cut:
                own[near(x[m], books[m])].append(x[m])
            books[m] = [tuple(sum(c) // len(own[j]) for c in zip(*own[j], strict=True)) if own[j] else e for j, e in enumerate(books[m])]
    codes = [[near(x[m], books[m]) for m in range(parts)] for x in cut]
    errors = [sum(far(x[m], books[m][c[m]]) for m in range(parts)) for x, c in zip(cut, codes, strict=True)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in code), e, by_label[label], sha) for (i, _, label), code, e in zip(kept, codes, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, numbers string, code int, sums string, own int, salt int, error string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], VECTORS)


@pytest.mark.parametrize("rounds", [0, 2, 5])
def test_vector_codes(spark, rounds, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 0.3, (9, 16))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.08, 16)).astype(np.float32).tolist(), None if i % 7 == 0 else i % 4) for i in range(400)]
    rows += rows[:5] + [(3, rows[9][1], 1), (None, rows[3][1], 2), (500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("-inf")] + [0.0] * 15, None)]
    rows += [(600 + i, [0.0] * 16, 5) for i in range(40)] + [(700, [-0.001] * 16, 5), (701, [1000.0] + [-3.5] * 15, 6)]
    found = Counter(map(tuple, vector_codes.compress(vectors(spark, rows), parts=4, entries=16, rounds=rounds).collect()))
    assert found == brute_codes(rows, 4, 16, rounds)
    monkeypatch.setattr(vector_codes, "SENT_LABELS", 0)
    assert Counter(map(tuple, vector_codes.compress(vectors(spark, rows), parts=4, entries=16, rounds=rounds).collect())) == found


def test_vector_codes_at_the_edges(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1), (2, [float("inf")] * 16, 2)])).collect() == []
    few = [(i, [float(i)] * 16, None) for i in range(3)]
    assert Counter(map(tuple, vector_codes.compress(vectors(spark, few)).collect())) == brute_codes(few, 16, 64, 2)
    huge = vector_codes.compress(vectors(spark, [(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1)])).collect()
    assert sorted(r["error"] for r in huge) == [0, 0]
    with pytest.raises(ValueError, match="multiple of 16"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 17, 1)]))


def test_bounds_spare_scans_and_use_net_moves(spark):
    """Bounds by net moves rule out more than by sums of steps, and never a nearer entry."""
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(0, 60, (3000, 2, 4)) + rng.choice([-200, 0, 200], (3000, 2, 1))).astype(np.int64)
    history = [x[:32].transpose(1, 0, 2).copy()]
    codes = vector_codes.first_codes(x, history[0])
    scanned = []
    for _ in range(6):
        history.append(vector_codes.moved_books(history[-1], vector_codes.sums(x, codes.code, 32)))
        codes = vector_codes.next_codes(x, np.stack(history), codes)
        plain = vector_codes.first_codes(x, history[-1])
        assert (codes.code == plain.code).all() and (codes.distance == plain.distance).all()
        # a bound is what its round's stamp says: no entry but the own one was nearer then
        for m in range(2):
            for g, lot in enumerate(vector_codes.groups(32)):
                for s in range(len(history)):
                    own = np.flatnonzero(codes.stamp[:, m, g] == s)
                    d = np.sqrt(vector_codes.distances(x[own, m], history[s][m][lot]).astype(float))
                    inside = (codes.code[own, m] >= lot.start) & (codes.code[own, m] < lot.stop)
                    d[np.flatnonzero(inside), codes.code[own, m][inside] - lot.start] = np.inf
                    assert (codes.low[own, m, g] <= d.min(axis=1)).all()
        scanned.append(codes.scanned)
    assert max(scanned) < 3000 * 2 * vector_codes.GROUPS
    assert scanned[-1] < scanned[0]


def naive_first_fit(sizes, capacity):
    room, bins = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= sizes[i]
        bins.append((i, k))
    return [k for _, k in sorted(bins)]


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(11)
    for _ in range(200):
        sizes = rng.integers(1, 65, int(rng.integers(1, 150)))
        bins, places, fill = first_fit.first_fit_decreasing(sizes, 64)
        assert bins.tolist() == naive_first_fit(sizes.tolist(), 64)
        assert np.bincount(bins, sizes).tolist() == fill.tolist()
        pieces = first_fit.without_gaps(sizes, 64)
        taken, covered = defaultdict(list), defaultdict(list)
        for i, start, n, b, place in pieces:
            taken[b].append((place, n))
            covered[i].append((start, n))
        for spans in (*taken.values(), *covered.values()):
            at = 0
            for begin, n in sorted(spans):
                assert begin == at and n > 0
                at += n
        assert {sum(n for _, n in x) for x in taken.values()} <= {1, 2, 4, 8, 16, 32, 64}
        assert {i: sum(n for _, n in x) for i, x in covered.items()} == dict(enumerate(sizes.tolist()))


@pytest.mark.parametrize("per_group", [7, 8192])
def test_packing_by_first_fit(spark, odd, odd_rows, empty, per_group):
    library = Tokenizer.from_file(WORD_BPE)
    rows = first_fit.pack(first_fit.cut_documents(odd, WORD_BPE), per_group=per_group).collect()
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in odd_rows]
    # of rows with one id, pieces belong to the text that their checksums fit
    expected = Counter()
    for i, x in ids:
        expected[i] += len(x)
    found = Counter()
    for r in rows:
        found[r["doc_id"]] += r["length"]
        fits = [x for i, x in ids if i == r["doc_id"] and len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert fits
    assert found == expected
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert first_fit.pack(first_fit.cut_documents(empty, WORD_BPE)).collect() == []


def test_word_ends_are_the_library(odd_rows):
    library, own = Tokenizer.from_file(WORD_BPE), WordEnds(WORD_BPE)
    texts = [t or "" for _, t in odd_rows] + ["it's don't \x1c x\x1dy İ ß <|startoftext|>abc ©® x́", "漢字a1 12'll", "a<|endoftext|>b c <|x", "\x85z\xa0q ​ w k", "İ" * 40]
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_production_tables_have_sql_shape(spark):
    """Columns of the three queries."""
    rows = make(spark, [(1, "a b")])
    assert first_fit.pack(first_fit.cut_documents(rows, WORD_BPE)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    turns = spark.createDataFrame([(0, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(turns).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert vector_codes.compress(vectors(spark, [(1, [0.5] * 16, 1)])).where(F.col("error") == 0).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
