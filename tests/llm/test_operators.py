"""Operators against brute force, on rows that are odd in every way."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom_llm_rows import make, prose
from marketloom.llm import decontamination, graph, html_text, jaccard, language, packing, quality, sharding, token_count, token_store, toxicity
from marketloom.llm.token_ids import WordCoder

BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SPACE_WORD, ALNUM_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def least_capacity(sizes, n):
    """Smallest feasible capacity, trying them all by bisection over plain greedy walks."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, shards, left = (low + high) // 2, 1, None
        left = mid
        for s in sizes:
            if s > left:
                shards, left = shards + 1, mid
            left -= s
        low, high = (low, mid) if shards <= n else (mid + 1, high)
    return low


def test_sharding(spark, odd, odd_rows, empty):
    rows = sharding.shard(odd, 5).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in odd_rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    texts = defaultdict(list)
    for i, t in odd_rows:
        texts[i].append(t)
    for r in rows:
        assert (r["size"], r["text_crc32"]) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts[r["doc_id"]]}
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for (crc, size), s in shard_of.items() if size > 1)  # null and empty are two groups
    order = odd.groupBy(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s")).orderBy("h")
    assert max(sum(r["size"] for r in x) for x in by.values()) <= least_capacity([r["s"] for r in order.collect()], 5)
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(make(spark, [(1, "a")] * 9)).select("shard").distinct().count() == 1


def brute_components(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = SPACE_WORD.findall(lower(t))
        sets.append(frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g].append(i)
    return Counter((i, len(s), i if not s else min(least[g], default=None)) for (i, _), s, g in zip(rows, sets, group, strict=True))


def test_jaccard(spark, odd, odd_rows, empty, monkeypatch):
    expected = brute_components(odd_rows)
    assert Counter(map(tuple, jaccard.near_duplicates(odd).collect())) == expected
    monkeypatch.setattr(jaccard, "OFTEN", 2)  # nearly every shared shingle is common
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "PER_RUN", 2)
    monkeypatch.setattr(jaccard, "PER_BUCKET", 64)
    monkeypatch.setattr(jaccard, "SENT_IDS", 0)
    assert Counter(map(tuple, jaccard.near_duplicates(odd.repartition(3)).collect())) == expected
    assert jaccard.near_duplicates(empty).count() == 0


def families(rng):
    """Texts that share shingles in every way that the join tells apart."""
    common = "all pages of this site are protected by law and may not be copied"
    rows = [(i, f"{prose(rng, 60, 9000)} {common} {prose(rng, 20, 9000)}") for i in range(60)]  # a shingle in all documents, linked with nothing
    frame = prose(rng, 90, 9000)
    rows += [(100 + i, f"{frame} own{i} tail{i}") for i in range(80)]  # identical prefixes and sizes, all linked
    half = prose(rng, 60, 9000)
    rows += [(200 + i, f"{half} {prose(rng, 16, 9000)}") for i in range(40)]  # near the bound: a link with none of the others
    base = prose(rng, 80, 9000).split(" ")
    for i in range(50):  # some links, some not
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = f"edit{rng.randint(0, 3)}"
        rows.append((300 + i, " ".join(words)))
    return rows + rng.choices(rows, k=60)


def test_jaccard_families(spark, monkeypatch):
    rows = families(random.Random(11))
    expected = brute_components(rows)
    docs = make(spark, rows).repartition(3)
    assert Counter(map(tuple, jaccard.near_duplicates(docs).collect())) == expected
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "PER_RUN", 7)
    monkeypatch.setattr(jaccard, "PER_PART", 5)
    monkeypatch.setattr(jaccard, "OFTEN", 9)
    assert Counter(map(tuple, jaccard.near_duplicates(docs).collect())) == expected


def test_jaccard_where_tokens_collide(spark, monkeypatch):
    """Shingles that agree in what is sent to the buckets cost work but no link."""
    monkeypatch.setattr(jaccard, "TOKEN_BITS", 7)
    rows = families(random.Random(12))[::3]
    assert Counter(map(tuple, jaccard.near_duplicates(make(spark, rows)).collect())) == brute_components(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40, 140)]
    star = [(500, 500 + i) for i in range(1, 60)]
    edges = chain + star + [(7, 7), (3, 2), (2, 3), (2, 3)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 40 for i in range(41, 141)} | {500 + i: 500 for i in range(1, 60)} | {3: 2}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, odd, odd_rows, empty):
    cut = packing.cut_documents(odd, BYTE_BPE)
    rows = packing.pack(cut, per_partition=20).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    expected = Counter()
    for i, t in odd_rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for piece, (a, b) in enumerate([(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]):
            expected[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in fill.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    found = packing.certificate(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    assert found["lower_bound"] <= found["sequences"] <= found["lower_bound"] * 11 // 9 + 1
    assert packing.pack(packing.cut_documents(empty, BYTE_BPE)).count() == 0


def test_packing_exchange(spark):
    """Partitions with gaps exchange pieces and come nearer to the bound, which best fit in each of them does not reach alone."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(20, 500, 3000).tolist() + [1024] * 50
    cut = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = packing.certificate(packing.pack(cut, per_partition=60, rounds=1))
    packed = packing.pack(cut, per_partition=60)
    exchanged = packing.certificate(packed)
    assert packed.count() == len(sizes) and packed.select("doc_id").distinct().count() == len(sizes)
    assert alone["lower_bound"] == exchanged["lower_bound"] <= exchanged["sequences"]
    assert exchanged["sequences"] < alone["sequences"]
    # certified partitions stand: pieces that fill sequences are never dealt again
    full = packing.pack(spark.createDataFrame([(i, 0, 0, 512, 0) for i in range(400)], cut.schema), per_partition=40)
    assert packing.certificate(full)["sequences"] <= 200 + 10


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, places, left = packing.best_fit_decreasing(sizes, 100)
        bound = packing.lower_bound(np.bincount(sizes, minlength=101), 100)
        assert bound <= len(left) <= bound * 11 // 9 + 1
        assert [100 - sizes[bins == b].sum() for b in range(len(left))] == left
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 7, minlength=101), 100) == 4


def test_token_counts(odd, odd_rows, empty):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    assert Counter(map(tuple, token_count.count_tokens(odd, WORD_BPE).collect())) == expected
    assert token_count.count_tokens(empty, WORD_BPE).count() == 0


ODD_TEXTS = ["", " ", "a b", "a  b", " a", "a ", "\na", "a\n", "a\n b", "a \nb", "\n", "a\nb c\n", "don't you're 's", "x<|endoftext|>\nc <|endoftext|>", "a\r\nb", "x\ty", "é ́ é", "漢字 かな", "\x00 a", "a\x1cb", "12³½ 4", "ΑΣΣ σς", "…“x” – y", "Ab, cD.%% e!!\nf;"]


def test_word_coder_is_the_library():
    tokenizer, coder = Tokenizer.from_file(BYTE_BPE), WordCoder(BYTE_BPE)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(ODD_TEXTS)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]


def test_pre_tokens_are_the_library(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    got = token_count.count_tokens(make(spark, list(enumerate(ODD_TEXTS))), WORD_BPE).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD_TEXTS)}


def test_separators_beside_other_documents(spark):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ["plain words here", "a\x1fb\nc", "the house, and water", "x\x1c\x1d \x85y\u2028z\r\n\x1e", "supercalifragilistic antidisestablishment", "\x1f", "'s\x1f's <|endoftext|>\x1f", "İ漢字\x1f\x0b\x0cé\xa0\u3000w", "\x1c\n\u0338\x1d x"]
    assert _counts(spark, texts) == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def _counts(spark, texts):
    """Counts where all texts come in one batch."""
    got = token_count.count_tokens(make(spark, list(enumerate(texts))).coalesce(1), WORD_BPE).collect()
    return {r["doc_id"]: r["n_tokens"] for r in got}


def test_quality(odd, odd_rows, empty, monkeypatch):
    def measures(t):
        t = t or ""
        w = SPACE_WORD.findall(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    expected = Counter((i, *measures(t)) for i, t in odd_rows)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    book = quality.ledger(odd).cache()
    assert Counter(map(tuple, book.select(*columns).collect())) == expected
    monkeypatch.setattr(quality, "PACKED_WORDS", 2)  # the path of very long texts
    assert Counter(map(tuple, quality.ledger(odd).select(*columns).collect())) == expected
    for words_ in (2, 65_536):  # windows whose hashes agree by chance
        monkeypatch.setattr(quality, "PACKED_WORDS", words_)
        monkeypatch.setattr(quality, "_hash", lambda words, i: F.pmod(F.xxhash64(F.get(words, i)), F.lit(2)) * F.lit(1 << 20))
        assert Counter(map(tuple, quality.ledger(odd).select(*columns).collect())) == expected
    kept = quality.apply_policy(book, "v1")
    assert kept.where("kept AND (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)").count() == 0
    assert kept.where("doc_id = 80 AND kept").count() == 1
    for r in quality.ablations(book, "v1").collect():
        without = tuple(x for x in quality.POLICIES["v1"] if x != r["rule"])
        assert r["n_failed"] == quality.apply_policy(book, (r["rule"],)).where("NOT kept").count()
        assert r["n_kept_without"] == quality.apply_policy(book, without).where("kept").count()
        assert r["n_only"] == r["n_kept_without"] - kept.where("kept").count()
    assert quality.ledger(empty).count() == 0


def test_token_store(spark, odd, odd_rows, empty, tmp_path):
    path = str(tmp_path / "ids")
    token_store.write(odd, BYTE_BPE, path)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = sorted(token_store.read_back(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] is not None and r["doc_id"] for r in rows] == sorted((i is not None and i for i, _ in odd_rows), key=lambda i: -1 if i is False else i)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in odd_rows}
    expected = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in odd_rows for x in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    got = token_store.read_documents(spark, path, [3, 80, 7, None, 12345])
    assert got == {3: [ids[3]], 80: [ids[80]], 7: got[7]} and ids[7] in got[7] and len(got[7]) == 2
    assert token_store.read_documents(spark, path, [None]) == {}
    assert token_store.store(empty, BYTE_BPE).count() == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_decontamination(spark, odd, odd_rows, empty, block):
    texts = dict(odd_rows)
    passage = " ".join(texts[50].split(" ")[28:60])
    items = [(1, passage), (2, passage.upper()), (3, "one"), (4, None), (5, "a b c d"), (6, "zz yy"), (None, " ".join(texts[80].split(" ")[5000:5012])), (10, passage + " tail"), (11, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall(lower(t))
        for j in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[j : j + 10])].add(i)
    expected = Counter()
    for i, t in odd_rows:
        w, hit, named = ALNUM_WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    named |= windows[tuple(w[j : j + n])] - {None}
                    hit |= set(range(j, j + n))
        expected[i, len(w), len(hit), len(named), decontamination.digest(named), bool(hit)] += 1
    assert Counter(map(tuple, decontamination.decontaminate(odd, bench, block=block).collect())) == expected
    assert decontamination.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(empty, bench).count() == 0


def test_toxicity(spark, odd, odd_rows, empty):
    rng = np.random.default_rng(2)
    rows = [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 300, 60)) + (" vile" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(t.endswith("vile")), "x") for i, t in rows] + [(None, 1, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    rated = toxicity.rate(make(spark, rows), labels).collect()
    assert len(rated) == 400
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rated)
    assert all(r["predicted"] == int((r["doc_id"] - 1000) % 5 == 0) for r in rated)
    other = toxicity.rate(odd, labels).collect()
    assert Counter(r["doc_id"] for r in other) == Counter(i for i, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in other)
    assert all(r["score"] == 0 for r in toxicity.rate(odd, labels.limit(0)).collect())
    assert toxicity.rate(empty, labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">no</a></ul></nav><!-- no --><div class="ad">no</div><article><h1>Head &amp; line</h1><p>One &lt;b&gt;
  two<p><b>three <i>four</b><br>five<div class="x"><table><tr><td>six<td>seven</table></div><aside>no</aside>
<form>no<input value="no"></form><section id="comments"><p>no</p></section></article><footer>no &copy; <p>no</footer></body></html>"""


def test_html_markup():
    assert html_text.text_of("http://a.b/c", PAGE, lambda _: False).split("\n") == ["Head & line", "One <b> two", "three four five", "six", "seven"]
    assert html_text.text_of(None, "plain  text &#233;&nbsp;x", lambda _: False) == "plain text é x"
    assert html_text.text_of(None, "<p>cut <b off", lambda _: False) == "cut <b off"
    assert html_text.text_of("x", "<div>" * 3000 + "deep", lambda _: False) == "deep"


@pytest.mark.parametrize("entries", [1000, 0])
def test_html_templates(spark, entries):
    box = "<div><b>About</b> this site</div>"
    rows = [(i, f"https://h.example/{i}", f"<body>{box}<div><p>text {i}</p><p>same line</p></div></body>", "x") for i in range(6)]
    rows += [(10, "https://other.example/", f"<body>{box}<p>alone alone alone alone</p></body>", "x"), (11, None, None, "x"), (12, "", "", "x"), (None, "https://h.example/0", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = html_text.extract(pages, entries=entries).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter([(i, f"text {i}\nsame line") for i in range(6)] + [(10, "About this site\nalone alone alone alone"), (11, ""), (12, ""), (None, "text 0\nsame line")])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0), entries=entries).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="home has-sidebar header-fixed"><p>long body text</p></body>', "long body text"),
        ('<body><article class="post comment-open"><p>the article</p></article><p>other</p></body>', "the article"),
        ('<body><article class="sidebar related"><p>the article</p></article><p>other</p></body>', "the article"),
        ('<html class="menu"><body id="header"><main class="share"><p>the main part</p></main></body></html>', "the main part"),
        ('<div id="page" class="sidebar"><div>x</div><article>the article</article></div><div class="related"><article>teaser</article></div>', "the article"),
        ('<div id="page" class="sidebar"><p>most of the text of this page</p></div><p>some more</p>', "most of the text of this page\nsome more"),
        ('<div class="no-ad load-menu">one</div><div class="Cookie-Banner">two</div><div class="x main-nav">three</div><p>four five six seven eight</p>', "one\nfour five six seven eight"),
        ('<aside><article>short card</article></aside><div>all of the text</div>', "all of the text"),
    ],
)
def test_html_names(page, text):
    assert html_text.text_of("http://a.b/c", page, lambda _: False) == text


@pytest.mark.parametrize("entries", [1000, 0])
def test_html_recurrence_is_by_distinct_pages(spark, entries):
    def html(body):
        return f"<html><body>{body}</body></html>"

    table = "<table><tr><td>one</td><td>two</td></tr></table>"
    rows = [(i, "https://copies.example/a", html(f"<div><p>The article that has been crawled often.</p>{table}</div>")) for i in range(8)]
    rows += [(100 + i, f"https://large.example/{i}", html(f"<p>page {i} of a large host</p>{table if i < 6 else ''}")) for i in range(100)]
    frame, quoted = "<p>Follow us for more</p><span>All rights reserved</span>", "<p>a quotation</p>"
    rows += [(300 + i, f"https://prose.example/{i}", html(f"{frame}<p>text {i} is <b>own</b></p>{quoted if i < 12 else ''}")) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), entries=entries).collect()}
    assert {got[i] for i in range(8)} == {"The article that has been crawled often.\none\ntwo"}
    assert {got[100 + i] for i in range(6)} == {f"page {i} of a large host\none\ntwo" for i in range(6)}
    assert [got[300 + i] for i in range(30)] == [f"text {i} is own" + ("\na quotation" if i < 12 else "") for i in range(30)]


def test_html_counts_and_deletions_are_brute_force(spark):
    """Site frames in elements of every kind, against counts of equal markup per host."""
    rng = random.Random(4)
    frames = ["<div>Read our <b>letter</b> each week</div>", "<table><tr><td>Plans</td><td>Prices</td></tr></table>", "<p>All rights reserved by us</p>", "<ul><li>Home page</li><li>Our team</li></ul>"]
    quote = "<p>a saying that a few pages have</p>"
    pages, expected = [], {}
    for host, n in (("a.example", 40), ("b.example", 12), ("c.example", 3)):
        for i in range(n):
            own = [f"<p>{prose(rng, 30, 9000)} {host} {i}</p>" for _ in range(3)] + [quote] * (i < 4)
            parts = frames[:2] + own + frames[2:]
            pages.append((len(pages), f"https://{host}/{i}", f"<body>{''.join(parts)}</body>", parts))
    counts = Counter((url.split("/")[2], part) for _, url, _, parts in pages for part in set(parts))
    size = Counter(url.split("/")[2] for _, url, _, _ in pages)
    for i, url, _, parts in pages:
        host, kept = url.split("/")[2], []
        for part in parts:
            n, prose_tag = counts[host, part], part.startswith("<p>")
            if not (n >= 10 and 2 * n >= size[host] if prose_tag else n >= 5 and 10 * n >= size[host]):
                kept += re.sub("<b>|</b>", "", part).replace("</td>", "\n").replace("</li>", "\n").split("\n")
        texts = (re.sub("<[^>]*>", "", x).strip() for x in kept)
        expected[i] = "\n".join(x for x in texts if x)
    rows = [(i, url, html) for i, url, html, _ in pages]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected
    assert "Home page" not in got[0] and "Home page" in got[54]


def test_html_copies_of_an_article_are_one_page(spark):
    """An article on many pages of a host, each with a frame of its own, is no template of the host."""
    rows = [(i, f"https://h.example/{i}", f"<body><nav>to {i}</nav><div>frame {i}</div><article><h1>Head</h1><p>The one text.</p><ul><li>first</li><li>second</li></ul></article></body>") for i in range(30)]
    rows += [(100 + i, f"https://h.example/x{i}", f"<body><article><p>Another text {i}.</p></article></body>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(30)} == {"Head\nThe one text.\nfirst\nsecond"}
    assert [got[100 + i] for i in range(5)] == [f"Another text {i}." for i in range(5)]


def test_language(spark, odd, odd_rows, empty):
    words = {"en": "the house and water of light with morning under trees".split(), "de": "das haus und wasser der schönen nacht unter bäumen".split()}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[k], 12)), k if i % 7 else None) for i in range(200) for k in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(docs, PIECES).collect()
    assert all(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    model = language.train(docs, PIECES)
    other = language.identify(odd, model, PIECES).collect()
    assert Counter(r["doc_id"] for r in other) == Counter(i for i, _ in odd_rows)
    assert {r["lang_pred"] for r in other if r["doc_id"] in (0, 1, 2, 82)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in other)
    assert {r["lang_pred"] for r in language.identify(odd, language.Model([], np.zeros(0), [], 0), PIECES).collect()} == {"und"}
    assert language.identify(empty, model, PIECES).count() == 0


def segmentations(text, index):
    """All ways to cut a text into pieces; a character that is none is -1."""
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in index or n == 1:
            for rest in segmentations(text[n:], index):
                yield (index.get(text[:n], -1), *rest)


def test_forward_sums_all_segmentations():
    vocabulary = language.Pieces(PIECES)
    p = np.random.default_rng(0).random((len(vocabulary.names) + 1, 2)) * 1e-3
    index = {x: i for i, x in enumerate(vocabulary.names)}
    for word in ("house", "straße", "xqz", "æ", "information"):
        got = language.log_probabilities([word], vocabulary, p)[0]
        each = np.array([p[list(s)].prod(0) for s in segmentations(language.BEGIN + word, index)])
        assert got == pytest.approx(np.log(each.sum(0)))


def test_long_words_are_scored_whole(monkeypatch):
    vocabulary = language.Pieces(PIECES)
    p = np.random.default_rng(0).random((len(vocabulary.names) + 1, 2)) * 1e-3
    words = ["information" * n for n in (1, 4, 9)] + ["x" * 70, "é" * 33]
    monkeypatch.setattr(language, "SCALED", 1000)
    plain = language.log_probabilities(words, vocabulary, p)
    for scaled in (1, 3, 16):
        monkeypatch.setattr(language, "SCALED", scaled)
        assert language.log_probabilities(words, vocabulary, p) == pytest.approx(plain)
    assert np.isfinite(language.log_probabilities(["ab" * 5000], vocabulary, p)).all()


@pytest.mark.parametrize("scaled", [2, 16])
@pytest.mark.parametrize("together", [1, 16])
def test_fit_and_identify_are_brute_force(spark, monkeypatch, scaled, together):
    monkeypatch.setattr(language, "SCALED", scaled)
    monkeypatch.setattr(language, "LANGUAGES", together)  # one by one is as many languages are
    vocabulary = language.Pieces(PIECES)
    index, size = {x: i for i, x in enumerate(vocabulary.names)}, len(vocabulary.names)
    texts = {"a": ["The house, the HOUSE", "water 12 light"], "b": ["das haus", "schöne nacht das", "haus"]}
    probability, prior = {}, {}
    for lang, own in texts.items():
        counts = Counter(w for t in own for w in language.words_of(t))
        p = np.full(size + 1, 1 / size)
        p[-1] = language.UNKNOWN
        for _ in range(language.EPOCHS):
            expected = np.zeros(size + 1)
            for w, n in counts.items():
                cuts = [list(s) for s in segmentations(language.BEGIN + w, index)]
                share = np.array([p[s].prod() for s in cuts])
                for s, x in zip(cuts, share / share.sum(), strict=True):
                    np.add.at(expected, s, n * x)
            p[:size] = (expected[:size] + language.SMOOTHING) / (expected[:size].sum() + language.SMOOTHING * size)
        probability[lang], prior[lang] = p, (len(own) + 1) / (5 + 2)
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, PIECES)
    assert model.languages == ["a", "b"] and model.prior == pytest.approx([prior["a"], prior["b"]])
    assert model.table() == pytest.approx(np.stack([probability["a"], probability["b"]], 1), rel=1e-5)
    asked = [(i, t) for i, t in enumerate(["the haus", "Nacht light", "zz", "1 2", "house" * 2])]
    for r in language.identify(make(spark, asked), model, PIECES).collect():
        found = language.words_of(dict(asked)[r["doc_id"]])
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        score = {k: prior[k] * np.prod([sum(probability[k][list(s)].prod() for s in segmentations(language.BEGIN + w, index)) for w in found]) for k in prior}
        best = max(sorted(score), key=score.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(score[best] / sum(score.values()), rel=1e-4)


def test_fitting_samples_hold_where_one_id_has_all_rows(spark):
    rows = [(7, f"the house number {'x' * (i % 50)} of light", "en") for i in range(300)] + [(7, f"das haus nummer {'x' * (i % 50)} nacht", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, PIECES, rows=40)
    assert set(model.languages) == {"en", "de"}
    same = spark.createDataFrame([(7, "the house", "en")] * 500, "doc_id long, text string, lang string")
    assert language.train(same, PIECES, rows=40).languages == ["en"]


def test_ftrl_is_brute_force():
    rng = np.random.default_rng(5)
    examples = [(np.unique(rng.integers(0, 30, 12)), int(rng.random() < 0.4)) for _ in range(60)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0 if i == "bias" else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for places, label in examples:
            at = [*places.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in examples])])
    model = toxicity.fit(np.concatenate([p for p, _ in examples]), ends, np.array([y for _, y in examples]))
    expected = {i: weight(i) for i in range(30) if weight(i)}
    assert dict(zip(model.places.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(expected)
    assert model.bias == pytest.approx(weight("bias"))


def test_pipeline(spark, odd_rows, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in odd_rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    passage = " ".join(dict(odd_rows)[80].split(" ")[100:130])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter([10, *range(50, 62), 85])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {10, *range(50, 62), 85}


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    near = f"{d} more"
    rows = [(7, a), (7, b), (7, c), (3, c), (7, a), (None, d), (None, near), (None, e), (9, e), (5, None), (5, None), (None, ""), (None, "")]
    docs = make(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    one = next(t for t in (d, near) if got[None, t])
    assert got == Counter([(7, a), (7, b), (3, c), (None, one), (9, e), (5, None), (5, None), (None, ""), (None, "")])


def test_pipeline_keeps_columns_of_any_name(spark):
    """Columns that are named as those of the stage itself keep their values and types."""
    import corpus_pipeline

    rng = random.Random(9)
    a, b = prose(rng, 80), prose(rng, 80)
    names = ("key", "no_id", "x", "y", "root", "set", "list", "group", "row", "component_id", "n_shingles")
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in ((1, a), (2, a), (1, a), (3, b), (None, ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, (rows[0], rows[3], rows[4])))


@pytest.fixture
def tables(spark, odd_rows, tmp_path):
    """A folder with what the stages read besides documents."""
    passage = " ".join(dict(odd_rows)[80].split(" ")[100:130])
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = np.random.default_rng(2)
    labelled = [(5000 + i, " ".join(f"w{x}y" for x in rng.integers(0, 300, 60)) + (" vile" if i % 5 == 0 else "")) for i in range(400)]
    spark.createDataFrame([(i, 0, int(t.endswith("vile"))) for i, t in labelled], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), labelled


def test_pipeline_stages_by_row(spark, odd_rows, tables):
    """Every stage keeps and drops rows by their texts, with clashing columns, null and repeated ids and repeated rows."""
    import corpus_pipeline

    folder, labelled = tables
    passage = " ".join(dict(odd_rows)[80].split(" ")[100:130])
    plain, other = prose(random.Random(1), 70, 9000), prose(random.Random(2), 70, 9000)
    rows = [*odd_rows, *labelled, (None, plain), (None, plain), (9000, other), (9000, other + " vile"), (9000, f"{other} {passage}"), (9001, f"{passage} {plain}"), (None, "vile"), (None, passage)]
    docs = make(spark, rows).withColumn("source", F.lit("s"))
    stages = dict(corpus_pipeline.STAGES)

    def kept(stage, docs):
        out = stages[stage](spark, docs, folder)
        assert out.schema.names == docs.schema.names
        return Counter((r["doc_id"], r["text"]) for r in out.collect())

    every = Counter(rows)
    toxic = every - kept("toxicity", docs)
    assert all("vile" in t for _, t in toxic) and {t for t, n in Counter(rows).items() if t[1] and t[1].endswith(" vile")} <= set(toxic)
    words = lambda t: ALNUM_WORD.findall(lower(t))
    windows = {tuple(words(passage)[i : i + 10]) for i in range(21)}
    hit = Counter(r for r in rows if windows & {tuple(words(r[1])[i : i + 10]) for i in range(len(words(r[1])))})
    assert every - kept("decontamination", docs) == hit and sum(hit.values()) >= 4
    good = kept("quality_rules", docs)
    assert good[None, plain] == 2 and not good[None, "vile"] and not good[0, None]
    near = kept("jaccard_join", docs)
    assert near[None, plain] == 1 and near[9000, other] + near[9000, other + " vile"] == 1
    packed = stages["packing"](spark, docs, folder)
    assert packed.where("piece = 0").count() == len(rows)


def test_pipeline_empty_tables(spark, tables):
    import corpus_pipeline

    folder, _ = tables
    docs = make(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


@pytest.mark.parametrize("block", [1000, 5])
def test_decontamination_items_of_any_type_and_number(spark, odd, odd_rows, block):
    """A passage that thousands of items have is one window of each block, and names them all."""
    passage = " ".join(dict(odd_rows)[80].split(" ")[300:312])
    items = [(f"item-{i}", passage) for i in range(3000)] + [("other", "nothing of it"), (None, passage)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r["doc_id"]: r for r in decontamination.decontaminate(odd, bench, block=block).where("contaminated").collect()}
    assert set(found) == {80}
    assert (found[80]["n_items"], found[80]["n_hit"]) == (3000, 12)
    assert found[80]["items_sha256"] == decontamination.digest([i for i, _ in items[:3000]])
    stays = decontamination.drop_contaminated(odd, bench, block=block)
    assert Counter(r["doc_id"] for r in stays.collect()) == Counter(i for i, _ in odd_rows) - Counter([80])


def text_without_templates(page):
    return html_text.text_of("http://a.example/b", page, lambda key: False)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><div class="content">long story</div><main></main></body>', "long story"),
        ('<div>a long story stands here</div><div class="rel"><article><h3>Teaser</h3><p>short</p></article></div>', "a long story stands here\nTeaser\nshort"),
        *((f"<article><p>The story.</p></article><div {c}><p>a much longer thing that isn't it, by far</p></div>", "The story.") for c in ('class="comment-list"', 'class="x commentlist"', 'id="respond"', "class=related-posts", "class='share-buttons'", 'class="ad"')),
        *((f"<div>The story, told at length.</div><div {c}>not it</div>", "The story, told at length.") for c in ('class="comment-list"', 'id="respond"', "class=related-posts", "class='share-buttons'")),
        ('<div class="has-sidebar widgetry">all of it</div>', "all of it"),
        ("<article>one</article><p>x</p><article>two</article><main></main>", "one\ntwo"),
        ("<article><p>x <math><mi>a</mi></math> y</p><select><option>no</select></article>", "x a y"),
        ('<p>a <a title="x>y">b</a> c</i> d<div>e</b></div>f</p><a href="cut', 'a b c d\ne\nf<a href="cut'),
        ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul><dl><dt>t<dd>d<dt>u</dl><table><tr><td>a<td>b<tr><td>c</table>", "1\n2\n3\n4\nt\nd\nu\na\nb\nc"),
    ],
)
def test_choice_of_the_article(page, text):
    assert text_without_templates(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" + "<a href=x>l</a>" * 60_000 + "</div>", "</b>" * 250_000, '<a "' * 250_000, '<a ">"' * 150_000, "<i>" * 250_000 + "<hr>" * 10_000, "<div><b><p>" + "<i>" * 100_000 + "</b>" * 100_000,
        "<ul>" + "<li>x" * 150_000, "<script>" + "</script " * 100_000, "<p>" + "<span>a</span>" * 60_000, "<!--" * 250_000, "<" * 1_000_000, '<p class="' + "ad-" * 300_000 + '">x', "<dl>" + "<dd><b>" * 100_000,
    ],
    ids=range(13),
)
def test_flat_and_broken_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    text_without_templates(page)
    assert time.process_time() - began < 30


def test_pages_with_an_empty_main_are_pages_of_their_own(spark):
    rows = [(i, f"http://empty.example/{i}", f"<body><div><span>Menu of the site</span></div><div>page {i} says {i} things of its own</div><main></main></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(pages).collect()} == {f"page {i} says {i} things of its own" for i in range(12)}


def test_many_languages_are_a_small_model(spark):
    """A dirty column of languages: what is sent grows with the sample, not with pieces times languages."""
    rows = [(i, f"{'abcdefghijklmnop'[i % 16] * 3} {'qrstuvwxyz'[i % 10] * 2} haus", f"l{i % 400}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, PIECES)
    assert len(model.languages) == 400
    assert sum(len(p) for p, _, _ in model.seen) < 400 * 60
    found = language.identify(docs, model, PIECES).collect()
    assert len(found) == 1200 and {r["lang_pred"] for r in found} <= set(model.languages)
    assert all(0 < r["score"] <= 1 for r in found)


def test_toxicity_features_and_scores_are_brute_force(spark, odd, odd_rows):
    """Words, neighbouring pairs and pairs around one word, each a place once per text, against a dictionary of strings."""
    from marketloom.llm.text_arrays import ALNUM, mix, words
    import pyarrow as pa

    texts = [t or "" for _, t in odd_rows]
    w = words(pa.array(texts), ALNUM)
    split = [ALNUM_WORD.findall(lower(t)) for t in texts]
    hash_of = {}
    for i, own in enumerate(split):
        hashes = w.hash[w.doc == i].tolist()
        assert len(hashes) == len(own)
        for name, h in zip(own, hashes, strict=True):
            assert hash_of.setdefault(name, h) == h  # a word has one hash wherever it stands
    assert len(set(hash_of.values())) == len(hash_of)

    def place(*parts):
        odd_ = {2: 0xA24BAED4963EE407, 3: 0x9FB21C651E98DF25}
        if len(parts) == 1:
            h = hash_of[parts[0]]
        else:
            mixed = (hash_of[parts[0]] * odd_[len(parts)] + hash_of[parts[-1]]) & (1 << 64) - 1
            h = int(mix(np.array([mixed], np.uint64))[0])
        return h & (1 << toxicity.BITS) - 1

    expected = []
    for own in split:
        found = [(x,) for x in own] + list(zip(own, own[1:], strict=False)) + [(a, None, c) for a, c in zip(own, own[2:], strict=False)]
        expected.append(Counter(place(*f) for f in found))
    doc, places = toxicity.features(w)
    got = [Counter() for _ in texts]
    for d, p in zip(doc.tolist(), places.tolist(), strict=True):
        got[d][p] += 1
    assert got == expected
    rng = np.random.default_rng(6)
    every = sorted({p for c in expected for p in c})
    chosen = np.array(sorted(rng.choice(every, len(every) // 3, replace=False)))
    model = toxicity.Model(chosen, rng.normal(0, 1, len(chosen)), -0.25, True)
    weight = dict(zip(chosen.tolist(), model.weights.tolist(), strict=True))
    plain = Counter((i, round(1 / (1 + np.exp(-(sum(weight.get(p, 0) for p in c) - 0.25))), 9)) for (i, _), c in zip(odd_rows, expected, strict=True))
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(odd, model).collect()) == plain
