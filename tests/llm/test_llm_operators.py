"""Every operator against brute force on a small table of odd cases, and on an empty one."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import messy, words
from pyspark.sql import functions as F

from variorum.llm import byte_bpe, chat_format, common, decontamination, jaccard_join, license_scan, quality_classifier, quality_rules, substring_dedup, suffix_array, suffix_dedup, url_filter

ROWS = [(i, (t or "").encode()) for i, t, *_ in messy()]


def collected(df, *columns):
    return sorted(map(tuple, df.select("doc_id", *columns).collect()), key=str)


def rules(text: bytes):
    w = text.split()
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.decode().split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text.decode())), dup, len(again)


def test_quality_rules(docs, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = collected(quality_rules.measures(docs), *names)
    assert got == sorted(((i, *rules(t)) for i, t in ROWS), key=str)
    assert quality_rules.measures(empty).count() == 0


def test_quality_verdicts(spark):
    """base_failed and kept by the rules one by one, beside columns of any name."""
    good = "the cat and the dog were in a house by the old river that was long and it had many a door"
    texts = [None, "too few words", good, good + " " + "!!! " * 40, "the end of it all is here now " * 12, good.upper(), " ".join(words(60, 9)), "\n".join(f"- {good} {i}" for i in "abcdefgh"), "# " * 12 + good, (good + "\n") * 4]
    docs = spark.createDataFrame([(i, t, i, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _words string, row string")
    m = quality_rules.measures(docs)
    assert m.columns == ["doc_id", "text", "_words", "row", *quality_rules.MEASURES]
    got = {r.doc_id: r.asDict() for r in m.select("*", quality_rules.base_failed().alias("failed"), (~quality_rules.base_failed() & quality_rules.verdict()).alias("kept")).collect()}
    for i, t in enumerate(texts):
        n, _, symbols, dup, again = rules((t or "").encode())
        failed = n < 10 or 100 * again > 20 * n
        assert (got[i]["n_words"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["failed"], got[i]["_words"]) == (n, symbols, dup, failed, "x")
        assert got[i]["kept"] == (not failed and all((a is None or got[i][k] >= a) and (b is None or got[i][k] <= b) for k, a, b in quality_rules.RULES))
    assert [i for i in got if got[i]["kept"]] == [2]


def test_byte_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lines, pattern = byte_bpe.vocabulary()
    ids = byte_bpe.encode(docs, lines, pattern)
    assert ids.columns == [*docs.columns, "ids"]
    assert collected(ids, "ids") == sorted(((i, e.encode_ordinary(t.decode())) for i, t in ROWS), key=str)
    back = byte_bpe.decode(ids.select("doc_id", "ids"), lines, pattern)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted(t for _, t in ROWS)
    assert byte_bpe.encode(empty, lines, pattern).count() == 0


def test_replay_with_lower_ranks_later():
    """A merge may bring up a pair of lower rank, which then goes first."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"aa", b"aaa", b"ca"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    ranks = byte_bpe.Ranks(lines)
    pieces = [b"abcabc", b"aaaaaaa", b"abca", b"cabcab", b"aabcaa", b"", b"bcabcaabc"]

    def plain(piece):
        if piece in ranks.rank:
            return [ranks.rank[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks.rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks.rank), default=None)
            if best is None:
                return [ranks.rank[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    ids, count = byte_bpe.replay(pieces, ranks)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain(p) for p in pieces]


def test_byte_bpe_digests_and_white_space(spark):
    """What the query returns, against tiktoken: runs of all kinds of white space, marks, null and empty texts, clashing columns."""
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    parts = [" ", " ", "  ", "\n", " \n", "\t", "a", "bc", "'s", "12", "!?", "\x1c", "\u3000", "é", "字", "\r\n", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "   ", " a", "  a", "a  ", "x" * 3000, "字" * 2000]
    docs = spark.createDataFrame([(i, t, "mine", "also") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.encode(docs, *byte_bpe.vocabulary(), digest=True).collect()}
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "x://example.net", "http://example.network/", "https://www.spam.org/p/1.html?a", "https://spam.org/p/1", "http://e.example.com/de/1", "http://q.org/fr/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("spam.org/p/1",), ("spam.org/p/1",), (None,)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        4: ("example.net", "", None, "allow"), 5: ("example.network", "/", None, "allow"), 6: ("www.spam.org", "/p/1.html", None, "block"),
        7: ("spam.org", "/p/1", None, "block"), 8: ("e.example.com", "/de/1", "example.com/de/", "block"), 9: ("q.org", "/fr/", "org/fr/", "allow"),
    }
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 1


def test_url_filter_beside_any_names(spark):
    names = ["_bits", "_block", "block", "row", "hit", "key", "asked", "host", "verdict", "mask", "spread", "a.b"]
    pages = spark.createDataFrame([("http://b.org/1", *range(len(names))), (None, *range(len(names)))], ["url", *names])
    got = url_filter.filter_urls(pages, spark.createDataFrame([("b.org/1",)], "canonical string"))
    kept = [c for c in names if c not in ("host", "verdict")]
    assert got.columns == ["url", *kept, "host", "path", "rule", "verdict"]
    assert sorted((r[0] or "", r[1:]) for r in got.collect()) == sorted((u, (*(names.index(c) for c in kept), *rest)) for u, rest in [("http://b.org/1", ("b.org", "/1", None, "block")), ("", ("", "", None, "allow"))])


def test_url_filter_without_broadcast(spark, monkeypatch):
    """Pages without a URL, or without a hit, stay whole where the list is shuffled; the same pages repeat."""
    urls = [None, None, "http://b.org/1", "http://www.b.org/1/", "http://b.org/2", "http://x.net/1", "http://7.org/1"] * 50
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    listed = spark.createDataFrame([("b.org/1",), ("-8",), ("",)], "canonical string")
    told = lambda: sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect())
    before = told()
    assert [v for _, _, v in before[:7]] == ["allow", "allow", "block", "block", "allow", "block", "allow"]
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert told() == before and len(before) == len(urls)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_url_filter_lists_whole_hosts(spark):
    urls = ["http://www.free-bets.example.com/en/51234", "https://m.spam-farm.example.org/es/7.html", "http://blog.cheap-pills.example.com/en/1", "http://nofree-bets.example.com/en/1", "http://free-bets.example.com.org/en/1", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, url_filter.listed_urls(pages)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def shingles(text: bytes):
    w = tuple(text.lower().split())
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def test_jaccard_join(docs, empty):
    sets = [(i, shingles(t)) for i, t in ROWS]
    group = {k: k for k in range(len(sets))}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, (_, s) in enumerate(sets):
        for b, (_, t) in enumerate(sets[:a]):
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                group[root(a)] = root(b)
    want = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[m][0] for m in range(len(sets)) if root(m) == root(k) and sets[m][0] is not None] if s else [i]
        want.append((i, len(s), min(ids, default=None)))
    assert collected(jaccard_join.join(docs), "n_shingles", "component_id") == sorted(want, key=str)
    assert jaccard_join.join(empty).count() == 0


def similar(r, n):
    """Two different sets of a similarity of 0.8 or more."""
    while True:
        u = np.unique(r.integers(0, 2**64, n, np.uint64))
        v = np.unique(np.concatenate([r.permutation(u)[int(r.integers(0, n // 5 + 1)) :], r.integers(0, 2**64, int(r.integers(0, n // 5 + 1)), np.uint64)]))
        common = len(np.intersect1d(u, v))
        if max(len(u), len(v)) > common and 100 * common >= 80 * (len(u) + len(v) - common):
            return u, v


def test_jaccard_segments_within_thresholds():
    """Of two similar sets each shares at least as many subsets as it needs, and whatever thresholds of 0 and 1 add up to H + 1, one segment lies within its own."""
    r = np.random.default_rng(5)
    bands = jaccard_join.Bands()
    second = 0
    for _ in range(1500):
        u, v = similar(r, int(r.integers(5, 150)))
        common = [(x, y) for x in bands.partitions(len(u)) for y in bands.partitions(len(v)) if x[0] == y[0]]
        assert common
        met = False
        for (band, segments, h), (_, _, g) in common:
            a, b = (jaccard_join.Segments(x, band, segments) for x in (u, v))
            shared = np.intersect1d(a.subsets(), b.subsets())
            if len(np.setxor1d(u, v)) > min(h, g):
                continue
            met = True
            assert len(shared) >= max(len(a.sizes) - h, len(b.sizes) - g)
            # thresholds of 1 wherever they can be: the subset, or a deletion on one side, is the same
            near = np.concatenate([shared, np.intersect1d(a.deletions()[1], b.subsets()), np.intersect1d(a.subsets(), b.deletions()[1])])
            if np.minimum(a.sizes, 2).sum() > h:
                assert len(near)
                second += len(near) > len(shared)
            elif np.minimum(b.sizes, 2).sum() <= g:
                assert len(np.intersect1d(a.elements(h + 1), b.elements(g + 1)))
        assert met
    assert second  # segments that only a one-deletion neighbourhood finds


def test_jaccard_allocation(spark):
    """Ten sets share all subsets but one, which in two of them differs by one element: the two look through the one-deletion list, not through a list of ten."""
    row = "sig long, cls long, slot long"
    for due in (7, 3):
        rows = [(seg, c, jaccard_join.slot(seg, 0, 2, 0, due - 8)) for seg in range(3) for c in range(10)]
        rows += [(100, 1, jaccard_join.slot(3, 0, 2, 0, due - 8)), (100, 2, jaccard_join.slot(3, 1, 2, 0, due - 8))]
        got = {r.sig for r in jaccard_join.allocated(spark.createDataFrame(rows, row)).collect()}
        # four segments that add 2 each: 7 needs them all; for 3 the neighbourhood of two and one list of ten do, for sets without it one list of ten
        assert got == ({0, 1, 2, 100} if due == 7 else {0, 100}), got


def brute_components(sets):
    n = len(sets)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if label[i] != label[j] and c * 100 >= 80 * (len(sets[i]) + len(sets[j]) - c):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_jaccard_join_of_near_copies(spark, monkeypatch):
    """A group of near copies about the threshold, passages that many texts share, short texts; blocks of a few sets."""
    r = random.Random(11)
    base, passage = words(150, 61), words(45, 62)
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"x{r.random()}"
        texts.append(" ".join(w))
    texts += [" ".join(words(r.randint(5, 40), 700 + k) + passage + words(r.randint(5, 40), 900 + k)) for k in range(80)]
    for k in range(60):
        w = words(r.randint(5, 30), 2000 + k)
        texts += [" ".join(w), " ".join(w[1:]), " ".join([*w, "end"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = brute_components([shingles(t.encode()) for t in texts])
    for block in (jaccard_join.BLOCK, 20):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = {x.doc_id: x.component_id for x in jaccard_join.join(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def cut(seqs, n):
    """For each sequence: which places a repeated run of n covers."""
    count = Counter(seq[i : i + n] for seq in seqs for i in range(len(seq) - n + 1))
    out = []
    for seq in seqs:
        mark = np.zeros(len(seq) + 1, int)
        for i in range(len(seq) - n + 1):
            if count[seq[i : i + n]] > 1:
                mark[i] += 1
                mark[i + n if i + n < len(mark) else -1] -= 1
        out.append(np.cumsum(mark)[: len(seq)] > 0)
    return out


def test_substring_dedup(docs, empty):
    seqs = [tuple(t.split()) for _, t in ROWS]
    want = []
    for (i, _), seq, mark in zip(ROWS, seqs, cut(seqs, 35), strict=True):
        want.append((i, len(seq), int(mark.sum()), b" ".join(w for w, m in zip(seq, mark, strict=True) if not m).decode()))
    for cells in (substring_dedup.CELLS, 1 << 10):  # a full sketch only lets more windows through
        got = substring_dedup.dedup(docs, cells=cells, carry=["lang", "key", "marks"])
        assert collected(got, "n_words", "n_removed", "kept") == sorted(want, key=str)
        assert got.select("rest.key", "rest.marks", "rest.lang").distinct().collect() == [(5, "x", "en")]
    assert substring_dedup.dedup(empty).count() == 0


def odd_rows(spark):
    """A doc_id that is the hash of a null text, texts that share a doc_id, repeated rows, null texts and ids."""
    long, other = " ".join(words(120, 31)), " ".join(words(90, 32))
    rows = [(42, long), (43, long), (None, None), (44, "short"), (44, other), (44, long + " end"), (None, other), (None, other), (45, None), (None, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_dedup_of_ids_that_clash(spark):
    rows, docs = odd_rows(spark)
    seqs = [tuple((t or "").split()) for _, t in rows]
    want = [(i, len(q), int(m.sum())) for (i, _), q, m in zip(rows, seqs, cut(seqs, 35), strict=True)]
    assert collected(substring_dedup.dedup(docs), "n_words", "n_removed") == sorted(want, key=str)
    seqs = [(t or "").encode() for _, t in rows]
    want = [(i, len(q), int(m.sum())) for (i, _), q, m in zip(rows, seqs, cut(seqs, 60), strict=True)]
    assert collected(suffix_dedup.dedup(docs, length=60, gram=16), "n_bytes", "n_removed") == sorted(want, key=str)


def test_known_windows_in_one_task(spark):
    """A passage that many documents of a task share, in several batches of it."""
    passage = words(50, 33)
    rows = [(i, " ".join(words(30, 100 + i) + passage + words(1200, 500 + i))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    seqs = [tuple(t.split()) for _, t in rows]
    want = [(i, 1280, int(m.sum())) for (i, _), m in zip(rows, cut(seqs, 35), strict=True)]
    assert collected(substring_dedup.dedup(docs), "n_words", "n_removed") == sorted(want, key=str)


def test_long_words_that_polynomials_confuse():
    """Two words of 2,048 bytes whose polynomial hashes agree modulo 2 ** 64 for any odd base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    x, y = (bytes(97 + (b ^ f) for b in bits) for f in (0, 1))
    h, _ = common.WordHashes()(pa.array([x, y], pa.binary()))
    assert h[0] != h[1]


def test_suffix_dedup(docs, empty):
    texts = [t for _, t in ROWS]
    want = []
    for (i, t), mark in zip(ROWS, cut(texts, 60), strict=True):
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        want.append((i, len(t), int(mark.sum()), spans, hashlib.sha256(bytes(c for c, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    for shard in (suffix_dedup.SHARD, 150):  # groups in one shard each, and cut into many
        got = suffix_dedup.dedup(docs, length=60, gram=16, shard=shard).withColumn("kept", F.sha2("kept", 256))
        assert collected(got, "n_bytes", "n_removed", "n_spans", "kept") == sorted(want, key=str)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_at_production_length(spark):
    """400 bytes, many documents that share passages and parts of them, repeats within a document, periodic texts; in one shard and in many."""
    r = random.Random(5)
    base = " ".join(words(900, 41)).encode()
    texts = []
    for k in range(250):
        parts = []
        for _ in range(r.randint(1, 3)):
            i = r.randrange(0, 2000)
            parts += [" ".join(words(r.randint(0, 25), 1000 + r.randrange(400))).encode(), base[i : i + r.choice([380, 399, 400, 401, 450, 700])]]
        texts.append(b" ".join(parts))
    texts += [b"ab" * 700, b"ab" * 650, b"a" * 1000, b"a" * 399, b"abc" * 140, base[:500] * 2, b""]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = []
    for i, (t, mark) in enumerate(zip(texts, cut(texts, 400), strict=True)):
        want.append((i, len(t), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), hashlib.sha256(bytes(c for c, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    for shard in (suffix_dedup.SHARD, 3000):
        got = suffix_dedup.dedup(docs, shard=shard).withColumn("kept", F.sha2("kept", 256))
        assert collected(got, "n_bytes", "n_removed", "n_spans", "kept") == sorted(want, key=str)


def test_suffix_dedup_of_zero_bytes(spark):
    """Texts that differ in trailing U+0000 alone, at the production length."""
    r = random.Random(8)
    base = "".join(r.choice("\0\0\0a") for _ in range(700))
    texts = []
    for _ in range(60):
        i = r.randrange(0, 300)
        texts.append("".join(r.choice("\0a") for _ in range(r.randint(0, 20))) + base[i : i + r.choice([399, 400, 401, 420])] + "\0" * r.randint(0, 30))
    texts += ["\0" * 900, "\0" * 401, "\0" * 399, "a" + "\0" * 450]
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = [(i, int(mark.sum()), hashlib.sha256(bytes(c for c, m in zip(t, mark, strict=True) if not m)).hexdigest()) for i, (t, mark) in enumerate(zip(raw, cut(raw, 400), strict=True))]
    for shard in (suffix_dedup.SHARD, 3000):
        assert collected(suffix_dedup.dedup(docs, shard=shard).withColumn("kept", F.sha2("kept", 256)), "n_removed", "kept") == sorted(want, key=str)


def test_suffix_array():
    """Which strings repeat in a shard of random contexts, against brute force."""
    r = np.random.default_rng(0)
    for turn in range(400):
        n, length, low = int(r.integers(1, 30)), 12, 97 * (turn % 2)
        group, left = np.sort(r.integers(0, 3, n)), r.integers(0, 9, n)
        right = r.integers(4, 13, n)
        parts = [r.integers(low, low + 2, x + y).astype(np.uint8) for x, y in zip(left, right, strict=True)]
        size = left + right
        start = np.cumsum(size) - size
        least, most = suffix_array.repeats(np.concatenate(parts), start, size, left, group, length)
        strings = [{i: (g, i, p[x - i : x - i + length].tobytes()) for i in range(x + 1) if x - i + length <= len(p)} for g, x, p in zip(group, left, parts, strict=True)]
        count = Counter(v for d in strings for v in d.values())
        for k, d in enumerate(strings):
            own = [i for i, v in d.items() if count[v] > 1]
            assert (least[k], most[k]) == ((min(own), max(own)) if own else (-1, -1))


def test_chat_format(spark):
    text = "a\\<|im_end|>\\\\<\\|\n"
    rows = [(1, 0, "user", text, 0), (1, 1, "assistant\n<|\\l", "", 0), (1, 2, "assistant", "<\\|\\", 0), (2, None, "assistant", None, 0), (2, 0, None, None, 0), (None, 0, "assistant", "x", 0), (1, 2, "assistant", "<\\|\\", 0), (3, 0, "user", "only", 0)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    f = chat_format.format_chats(chats)
    read = f.select("conv_id", "example", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), "loss_start").collect()
    by = {(r.conv_id, r.example): r for r in read}
    assert [tuple(x) for x in by[1, 3 - 1].t] == [("user", text), ("assistant\n<|\\l", ""), ("assistant", "<\\|\\"), ("assistant", "<\\|\\")]
    assert [by[1, k].loss for k in (1, 2)] == ["<\\|\\", "<\\|\\"]
    assert by[2, 1].loss == "" and by[2, 1].loss_start is not None and by[2, 2].loss_start is None
    assert by[None, 1].loss == "x" and by[3, 1].loss_start is None and len(by) == 6
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(100 + k, " ".join(t.split()[a:b]), 1) for k, (t, a, b) in enumerate([(messy()[0][1], 10, 40), (messy()[10][1], 5000, 5060), (messy()[3][1], 50, 66)])]
    bench = spark.createDataFrame([*items, (7, None, 1), (8, "", 1), (9, "nothing like it is here at all in any text", 1)], "item_id long, text string, share int")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 100), (2, 100), (3, 100), (15, 100), (11, 101), (4, 102), (5, 102)}
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_paraphrases(spark):
    """Items planted word for word, with every tenth word changed or dropped, and with neighbours swapped; short items word for word. Recall is 0.9 or more for each kind, and texts of the same words in another order stay."""
    r = random.Random(8)
    vocabulary = [w for w in dict.fromkeys(words(4000, 1)) if len(w) > 2]
    weight = [1 / (k + 5) for k in range(len(vocabulary))]
    draw = lambda n: r.choices(vocabulary, weight, k=n)
    items = [(k, draw(r.choice([18, 25, 40, 60, 90, 150]))) for k in range(120)] + [(1000 + k, draw(r.randint(5, 11))) for k in range(30)]

    def changed(w, kind):
        w = list(w)
        if kind == "replaced":
            return [r.choice(vocabulary) if i % 10 == 4 and i < 0.7 * len(w) else x for i, x in enumerate(w)]
        if kind == "dropped":
            return [x for i, x in enumerate(w) if i % 10 != 4 or i >= 0.7 * len(w)]
        if kind == "swapped":
            for i in range(0, int(0.7 * len(w)) - 1, 8):
                w[i], w[i + 1] = w[i + 1], w[i]
        return w

    rows, want = [], {}
    for k, w in items:
        for kind in ("exact", "replaced", "dropped", "swapped") if k < 1000 else ("short",):
            want[len(rows)] = (k, kind)
            rows.append((len(rows), " ".join(draw(r.randint(20, 300)) + changed(w, kind) + draw(r.randint(20, 300)))))
    clean = len(rows)
    rows += [(clean + k, " ".join(draw(400))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(docs, bench).collect()}
    caught = Counter(kind for d, (k, kind) in want.items() if (d, k) in found)
    total = Counter(kind for _, kind in want.values())
    assert all(caught[kind] >= 0.9 * n for kind, n in total.items()), (caught, total)
    assert caught["short"] == total["short"] and not [d for d, _ in found if d >= clean]


def test_decontamination_of_whole_tables(spark, monkeypatch):
    """The decomposition is that of all documents and items; items of few words and without an item_id are found; nothing that a comparison with every passage finds is lost."""
    r = random.Random(4)
    vocabulary = list(dict.fromkeys(words(1500, 2)))
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(k, text(r.randint(15, 60))) for k in range(12)] + [(None, text(30)), (50, "zyx"), (51, "Zyx, wvu"), (52, "one zyx wvu")]
    rows = [(k, text(r.randint(5, 120)) + " " + items[k % 13][1] if k % 9 == 0 else text(r.randint(5, 60))) for k in range(700)]
    rows += [(800, "a zyx here"), (801, "one (zyx wvu) " + text(200)), (802, "wvu one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    product, seen = decontamination.product, []
    monkeypatch.setattr(decontamination, "product", lambda texts, *more: [seen.append(texts.count()), product(texts, *more)][1])
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(docs, bench).collect()}
    assert set(seen) == {len(rows) + len(items)}
    assert {(800, 50), (801, 50), (801, 51), (801, 52)} <= got and not [x for x in got if x[0] == 802]
    assert {(k, items[k % 13][0]) for k in range(0, 700, 9)} <= got
    monkeypatch.setattr(decontamination, "COSINE", -2.0)
    every = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(docs, bench).collect()}
    assert got <= every and len(got) >= 0.9 * len(every)


def test_product_of_passages():
    """A block's part of the product against one passage after the other."""
    r = np.random.default_rng(1)
    at = np.array([0, 0, 500, 530, 9000])
    h = r.integers(0, 900, at[-1]).astype(np.uint64)
    idf, right, weight = r.random(decontamination.FEATURES).astype(np.float32), r.random((decontamination.FEATURES, 8)).astype(np.float32), np.array([1.0, 1.0, 7.0, 2.0])
    got, want = np.zeros_like(right), np.zeros(right.shape)
    decontamination.add_product(h, at, weight, idf, right, got)
    for k in range(4):
        for i in range(at[k], at[k + 1], decontamination.PART):
            f, n = np.unique(h[i : min(i + decontamination.PART, at[k + 1])].astype(np.int64), return_counts=True)
            w = n * idf[f].astype(float)
            w *= np.sqrt(weight[k] / (w @ w))
            want[f] += np.outer(w, w @ right[f])
    assert np.abs(got - want).max() < 1e-4 * want.max()


def test_quality_classifier(spark, sf_dir, docs, empty):
    got = quality_classifier.op10_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.9
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, None), (999, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.score(docs, model).where("score between 0 and 1").count() == len(ROWS)
    assert quality_classifier.filter_rows(docs, model).columns == docs.columns
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(empty, none).count() == 0


def test_license_scan(spark, docs, empty):
    notices = ["Licensed under the Apache License, Version 2.0.", "x\nReleased under the MIT License.\ny", "fahrt mit der license", "This work is licensed under the GNU General Public License, version 3."]
    more = spark.createDataFrame([(50 + k, t, 5, "x", "en") for k, t in enumerate(notices)], docs.schema)
    scanner = license_scan.fit(docs)
    got = {r.doc_id: r.families for r in license_scan.scan(docs.union(more), scanner).collect()}
    assert {k: v for k, v in got.items() if v} == {50: "apache", 51: "mit", 53: "gpl"}
    assert license_scan.scan(empty, scanner).count() == 0


def test_license_families_that_differ_by_short_words(spark, docs):
    texts = ["Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "mit cc nc sa gnu bsd"]
    more = spark.createDataFrame([(i, "word " * 500 + "\n" + t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.scan(more, license_scan.fit(docs.select("doc_id", "text"))).collect()}
    assert got == {0: "cc-by", 1: "cc-by-nc", 2: "cc-by-sa", 3: None}


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction."
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met."
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation."


def test_wrapped_license_notices(spark, docs):
    """Notices over several lines, alone, between paragraphs and inside one; two of a family that stand in one paragraph count by line."""
    prose = "The river rose in spring and nobody crossed it.\nThey waited for the ferry."
    cases = [
        (MIT, "mit", 1), (BSD, "bsd", 1), (GPL, "gpl", 1),
        (prose + "\n\n" + MIT + "\n \t\n" + prose, "mit", 1), (prose + "\n" + GPL + "\n" + prose, "gpl", 1),
        (BSD + "\n\n" + GPL, "bsd,gpl", 2), ("Released under the MIT License.\n" + prose, "mit", 1),
        (prose, None, 0), ("\n\n \n", None, 0), (None, None, 0),
    ]
    more = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    found = license_scan.scan(more, license_scan.fit(docs.select("doc_id", "text")))
    got = {r.doc_id: (r.families, r.n_notices) for r in found.collect()}
    assert got == {i: (family, n) for i, (_, family, n) in enumerate(cases)}
    assert found.where("doc_id = 3").first().n_paragraphs == 3
