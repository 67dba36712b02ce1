"""Each query against its plain version, on the smallest tables and on hand-made documents.

The hand-made ones hold NULL ids and texts, empty and long texts, repeated rows, ids shared by different texts,
and extra columns named like the operators' own.
"""

from __future__ import annotations

import collections
import random
import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tillbook.llm import bpe, chunk_dedup, components, language_id, pii, quality_rules, queries, sharding, simhash, suffix_dedup, token_counts

Q = queries.QUERIES
LONG = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore "
HAZARDS = [(1, None), (2, ""), (2, ""), (None, " \n\t"), (3, "a"), (3, "a"), (4, "A b"), (5, "a b"), (None, "zz yy xx ww"),
           (6, "x " * 3000), (7, LONG * 3), (7, LONG * 3), (8, "né à é " * 90), (None, "né à é " * 90), (9, "né à é " * 90 + "!"),
           (3, "other text of the same id"), (10, "q" * 5000), (11, LONG + "né à é " * 30 + LONG[:50])]


def got(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def same(df, expected):
    assert got(df) == sorted(expected, key=repr)


def test_decontamination(spark, rows, frame):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    same(Q["op1_benchmark_decontamination"](spark, SF), brute.decontaminate(rows, items))


BENCH = [(1, "a b c"), (2, "the"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(9))), (6, "x0 x1 " * 150),
         (7, "A É ünï 9 B " * 5), (8, " ".join(f"w{i}" for i in range(20))), (8, "zz yy"), (None, "k l m")]
CASES = HAZARDS + [(20, "q a B c the the " + "x0 x1 " * 200), (21, " ".join(f"w{i}" for i in range(2, 16))),
                   (22, " ".join(f"w{i}" for i in range(12))), (23, "é A É ünï 9 B A É ünï 9 B A É ünï 9 B a"),
                   (24, "zz,yy" + "k" * 100_000), (25, "x0 x1 " * 6 + "x0")]


def test_decontamination_hazards(spark, frame):
    frame(CASES, {"benchmark": (BENCH, "item_id long, text string")})
    same(Q["op1_benchmark_decontamination"](spark, ""), brute.decontaminate(CASES, [b for b in BENCH if b[0] is not None]))
    frame(CASES, {"benchmark": ([], "item_id long, text string")})
    same(Q["op1_benchmark_decontamination"](spark, ""), brute.decontaminate(CASES, []))


def check_shards(rows, result, shards=24):
    """Minimal largest shard for the order of the groups, whole groups, gapless slots, all rows."""
    def size(t):
        return len((t or "").encode()) + 8

    assert collections.Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows) == collections.Counter(
        (r.doc_id, r.size, r.text_crc32) for r in result)
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    total = sum(size(t) for _, t in rows)

    def place(t):
        n, ids = size(t) * len(groups[t]), [d for d in groups[t] if d is not None]
        digest = b"" if t is None else bytes.fromhex(brute.sha(t))
        return (-n if n * shards > total else 0, bool(ids), min(ids, default=0), digest)

    sizes = [size(t) * len(groups[t]) for t in sorted(groups, key=place)]

    def enough(capacity):
        used, fill = 1, 0
        for s in sizes:
            used, fill = (used, fill + s) if fill + s <= capacity else (used + 1, s)
        return used <= shards

    least = next(c for c in range(max(sizes, default=0), total + 1) if enough(c)) if total < 3_000 else None
    if least is None:
        low, high = max(sizes), total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid + 1, high)
        least = low
    by = collections.defaultdict(list)
    for r in result:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    assert max(sum(r.size for r in v) for v in by.values()) == least
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))


def test_sharding(spark, rows, frame):
    result = Q["op2_sharding"](spark, SF).collect()
    check_shards(rows, result)
    of, text = {}, dict(rows)
    for r in result:
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
    frame(HAZARDS)
    check_shards(HAZARDS, Q["op2_sharding"](spark, "").collect())
    frame([])
    assert Q["op2_sharding"](spark, "").collect() == []


def test_sharding_by_look_ups(spark, monkeypatch):
    """The brackets narrowed by look-ups, with hardly any prefix sums on the driver."""
    monkeypatch.setattr(sharding, "BINS", 16)
    monkeypatch.setattr(sharding, "FETCH", 20)
    monkeypatch.setattr(sharding, "TRIED", 3)
    r = random.Random(3)
    rows = [(i, r.choice("abcd") * min(5000, int(r.paretovariate(.7) * 20))) for i in range(300)]
    check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_chunk_dedup(spark, rows, frame):
    same(Q["op3_substring_dedup"](spark, SF), brute.chunk_dedup(rows, chunk_dedup.GEAR))
    frame(HAZARDS)
    same(Q["op3_substring_dedup"](spark, ""), brute.chunk_dedup(HAZARDS, chunk_dedup.GEAR))


def test_chunks_resist_shifts(spark):
    """A passage of over 50 words is found at another offset, and is cut out of all documents but the first."""
    r = random.Random(9)

    def words(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))

    shared = [words(60) for _ in range(20)]
    rows = [(i, words(r.randint(5, 200)) + " " + shared[i % 20] + " " + words(30)) for i in range(60)]
    out = {x.doc_id: x for x in chunk_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == 0 for i in range(20))
    assert all(out[i].n_removed > 0 for i in range(20, 60))


def test_simhash(spark, rows, frame):
    same(Q["op4_simhash_near_dedup"](spark, SF), brute.simhash(rows))
    frame(HAZARDS)
    same(Q["op4_simhash_near_dedup"](spark, ""), brute.simhash(HAZARDS))


def test_tiles_lose_no_link(spark, monkeypatch):
    """Random fingerprints with neighbours, in tiles of a few: components as by all pairs."""
    monkeypatch.setattr(simhash, "TILE", 8)
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 60, np.uint64)
    flips = [x ^ (np.uint64(1) << np.uint64(int(i))) ^ (np.uint64(1) << np.uint64(int(j)))
             for x in a for i, j in r.integers(0, 64, (4, 2))]
    fps = np.unique(np.concatenate([a, np.array(flips, np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {x.node: x.root for x in components.components(simhash.near_links(simhash.tiles(frame))).collect()}
    label = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    label = components.labels(len(fps), i, j, label)
    groups = collections.defaultdict(set)
    for x, at in zip(fps.view(np.int64).tolist(), label.tolist(), strict=True):
        groups[at].add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
        frozenset(n for n in found if found[n] == root) for root in set(found.values())}


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5)]
    found = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1301)}}


def test_language_id(spark, rows, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = Q["op5_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [x for x in out if x.held_out]
    assert {x.doc_id for x in held} == {x.doc_id for x in out if zlib.crc32(str(x.doc_id).encode()) % 3 == 1}
    assert sum(x.lang == x.lang_pred for x in held) >= 0.99 * len(held)
    assert all(0 <= x.score <= 1 for x in out)
    frame(HAZARDS)  # nothing to learn from
    assert {(x.lang_pred, x.score) for x in Q["op5_language_id"](spark, "").collect()} == {("und", 0.0)}


def test_language_of_odd_texts(spark):
    learn = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("nothing", None), (None, "xx")],
                                  "text string, lang string")
    odd = [(1, None), (2, ""), (3, "12 ² _ !?"), (4, "the"), (5, "漢字"), (6, "chien " * 50_000), (6, "chien " * 50_000)]
    out = language_id.language_id(spark.createDataFrame(odd, "doc_id long, text string"), learn).collect()
    assert [x.lang_pred for x in sorted(out, key=lambda x: x.doc_id)][:4] == ["und", "und", "und", "en"]
    assert {x.lang_pred for x in out if x.doc_id == 6} == {"fr"} and next(x for x in out if x.doc_id == 5).lang_pred != "und"


def test_language_by_listed_segmentations(spark):
    """lang_pred and score of short words, every segmentation listed; pieces of all lengths."""
    r = random.Random(7)
    vocab = language_id.vocabulary()
    known = [p for p in vocab if p.isascii()]
    assert max(map(len, vocab)) > 8
    rare = sorted((p for p in known if 9 <= len(p) <= 12), key=lambda p: (len(p), p))[:40]
    learn = [(" ".join(r.choices(known[i::3], k=25)) + " " + " ".join(r.choices(rare, k=4)), lang) for i, lang in enumerate(["aa", "bb", "cc"])]
    learn += [("not learned", None), (None, "dd"), ("", "ee")]
    texts = [(i, " ".join(w[:11] for w in r.choices(known, k=r.randint(1, 30)))) for i in range(40)]
    texts += [(100 + i, w) for i, w in enumerate(rare)] + [(200, "ab漢 字x"), (201, None), (202, " 12 "), (203, "É é Ünder")]
    out = language_id.language_id(spark.createDataFrame(texts, "doc_id long, text string"),
                                  spark.createDataFrame(learn, "text string, lang string")).orderBy("doc_id").collect()
    for x, (lang, score) in zip(out, brute.languages(texts, learn, vocab), strict=True):
        assert x.lang_pred == lang and abs(x.score - score) < 1e-6


def test_long_words_are_not_cut(monkeypatch):
    """The windowed pass gives what the pass over whole columns gives, and takes words of any length."""
    vocab = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "abba", "bab", "aabb"])}
    counts = np.array([[3.0, 2, 4, 1, 5, 1, 2], [1, 5, 0, 2, 1, 3, 1]])
    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(n)) for n in range(1, 31)]
    model = language_id.PieceModel(["x", "y"], vocab, counts)
    scores, uses = model.log_words(words), language_id.expected_uses(words, np.arange(1.0, 31), vocab)
    monkeypatch.setattr(language_id, "LONG_WORD", 0)
    assert np.allclose(model.log_words(words), scores) and np.allclose(language_id.expected_uses(words, np.arange(1.0, 31), vocab), uses)
    long = "ab" * 3000
    one, two = model.log_words([long, long * 2])
    assert np.isfinite(two).all() and np.allclose(two / one, 2, rtol=1e-2)
    assert np.isfinite(language_id.expected_uses([long], np.ones(1), vocab)).all()


def test_forward_sums_all_segmentations():
    vocab = {"a": 0, "b": 1, "ab": 2, "ba": 3}
    model = language_id.PieceModel(["x", "y"], vocab, np.array([[3.0, 2, 4, 1], [1, 5, 0, 2]]))

    def ways(word):
        if not word:
            yield []
        for i in range(1, len(word) + 1):
            if word[:i] in vocab:
                yield from ([word[:i], *rest] for rest in ways(word[i:]))

    for word in ("a", "ab", "abab", "babaab"):
        exact = [sum(np.prod([model.prob[vocab[p], k] for p in w]) for w in ways(word)) for k in range(2)]
        assert np.allclose(np.exp(model.log_words([word, "a"])[0]), exact)
        weight = [0.125 ** len(w) for w in ways(word)]
        for p, i in vocab.items():
            uses = sum(x * w.count(p) for x, w in zip(weight, ways(word), strict=True)) / sum(weight)
            assert np.isclose(language_id.expected_uses([word], np.ones(1), vocab)[i], uses)


ODD = ["", " ", "Hello WORLD's <|endoftext|> I'll x<|startoftext|>y İΣΑΣ ΣΊΣΥΦΟΣ ﬁ é ½²٣ 日本語テスト 👩‍👩‍👧 a\x1cb\x85c d​e　f naïve '''s", "a" * 3000,
       "<|endoftext|" * 3, "<|endoftext|>" * 3, "ǅ ß ẞ K Å Ω", "'re n't 12345 x_y\x00z"]


def test_bpe(spark, rows, frame):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.VOCABULARY)

    def expected(rows):
        for (d, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
            yield (d, len(e.ids), brute.sha(np.array(e.ids, "<u4").tobytes()),
                   brute.sha(library.decode(e.ids, skip_special_tokens=False)))

    same(Q["op6_bpe_round"](spark, SF), expected(rows))
    r = random.Random(5)
    letters = [chr(c) for c in [*range(0x600), *range(0x1E00, 0x2100), *range(0x3040, 0x30FF), *range(0x1F600, 0x1F640)]]
    odd = HAZARDS + [(i, t) for i, t in enumerate(ODD)] + [(i, "".join(r.choice(letters) for _ in range(200))) for i in range(60)]
    frame(odd)
    same(Q["op6_bpe_round"](spark, ""), expected(odd))


def test_suffix_dedup(spark, rows, frame, monkeypatch):
    same(Q["op7_suffix_array_dedup"](spark, SF), brute.suffix_dedup(rows))
    r = random.Random(4)
    base = ["".join(r.choice("abcd ") for _ in range(600)) for _ in range(4)]
    odd = HAZARDS + [(50, base[1] + "é" * 150 + base[2][:230]), (51, "zz" + base[1][100:320] + "y"), (52, base[3]), (53, base[3][:199])]
    for i in range(30):  # near copies: edits at single places
        s = list(base[i % 4])
        for _ in range(r.randint(1, 4)):
            s[r.randrange(600)] = "Z"
        odd.append((100 + i, "".join(s)))
    frame(odd)
    same(Q["op7_suffix_array_dedup"](spark, ""), brute.suffix_dedup(odd))
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)  # larger groups by the digests of their windows
    same(Q["op7_suffix_array_dedup"](spark, ""), brute.suffix_dedup(odd))


def test_levels_merge_geometrically(spark):
    family = suffix_dedup.SuffixFamily()
    for i in range(7):
        batch = spark.createDataFrame([(i, 1), (99, 1), (i - 1, 1)], "g long, n long")
        found = {x.g for df in family.add(batch) for x in df.collect()}
        assert found == ({99, i - 1} if i else set())
    assert [size for size, _ in family.levels] == [4, 2, 1] or [size for size, _ in family.levels] == [4, 1, 1, 1]


def test_token_counts(spark, rows, frame):
    encode = token_counts.counter(token_counts.RANKS).encoding.encode_ordinary
    edits = collections.defaultdict(list)
    for e in queries.edits_of(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        edits[e.doc_id].append(e)
    expected = []
    for d, t in rows:
        s = t
        for e in sorted(edits[d], key=lambda e: e.edit):
            s = s[:e.at] + e.inserted + s[min(len(s), e.at + e.deleted):]
        expected.append((d, len(encode(t)), len(encode(s)), 3, brute.sha(s)))
    df = Q["op8_token_counts"](spark, SF)
    same(df.drop("n_encoded"), expected)
    assert df.agg(F.sum("n_encoded") * 10 < F.sum("n_tokens")).first()[0]
    frame(HAZARDS)
    assert Q["op8_token_counts"](spark, "").count() == len(HAZARDS)


def test_random_edits(monkeypatch):
    """Counts, leaves and boundaries after each of many edits, as by cutting the whole text anew."""
    count = token_counts.counter(token_counts.RANKS)
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\n\n ", "'s", "'re", "'", "r", "e", "the", "123", "!?", "é", "ü ", "　", "word", " 's", "\t"]
    for leaf in (1, 2, 7, 64):
        for _ in range(60):
            text = "".join(r.choice(bits) for _ in range(r.randint(0, 300)))
            pre = token_counts.PATTERN.findall(text)
            at = range(0, len(pre), leaf)
            tree = token_counts.Tree(text, [sum(map(len, pre[i:i + leaf])) for i in at],
                                     [sum(count.count(pre[i:i + leaf])) for i in at], count)
            for _ in range(6):
                a, d = r.randint(-2, len(text) + 3), r.choice([0, 0, 1, 2, 5, 30, 1000])
                new = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 6])))
                b = min(max(a, 0), len(text))
                text = text[:b] + new + text[min(b + d, len(text)):]
                tree.edit(a, d, new)
                now, chars, _, n = tree.state()
                assert now == text and n == len(count.encoding.encode_ordinary(text))
                ends = {0} | {m.end() for m in token_counts.PATTERN.finditer(text)}
                assert set(np.cumsum([0, *chars]).tolist()) <= ends and sum(chars) == len(text)


def test_edits_hazards(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, None, None, None, "hey you"), (None, 1, 0, 1, "z"), (2, 2, 50, 3, None), (2, 1, -4, 0, "it"),
                                   (77, 1, 0, 0, "no such document")], "doc_id long, edit long, at long, deleted long, inserted string")
    states = token_counts.count_tokens(docs)
    assert got(token_counts.apply_edits(states, edits), "doc_id", "text", "n_tokens") == sorted(
        [(1, "hey you", 2), (None, "a b", 2), (2, "it", 1), (2, "it", 1)], key=repr)
    again = token_counts.apply_edits(token_counts.apply_edits(states, edits), edits)
    assert got(again, "doc_id", "text") == sorted([(1, "hey youhey you"), (None, "a b"), (2, "itit"), (2, "itit")], key=repr)


PRIVATE = [(30, "a@b.com_x@y.org @z a@ a@b x.y@q.w..c 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"), (31, "mail bob@x.org alpha betaa gamma"),
           (32, "mail bob@x.org alpha betaa zeta"), (33, "x mail BOB@x.org alpha deltaa 5551"), (33, "x mail BOB@x.org alpha deltaa 5551"),
           (34, "9" * 20_000 + " +1 (555) 123-4567 4111 1111 1111 1111"), (35, "gamma betaa"), (36, "1.2.3.4@x.com"),
           (37, "see 4111111111111111@x.com or +4111111111111111"), (38, "0" * 5000 + ".1.2.3 and 1." + "0" * 9000 + ".2.3")]


def test_pii(spark, rows, frame):
    same(Q["op9_pii"](spark, SF), brute.pii(rows))
    far = " ".join(f"w{i}" for i in range(40))
    odd = HAZARDS + PRIVATE + [(200 + i, f"filler word{i} {far}") for i in range(400)]
    odd += [(700 + i, f"Secretname {far} {i} mail ann@y.org") for i in range(3)] + [(704, "Secretname"), (705, "Oy ann@y.org"), (706, far)]
    docs = frame(odd)
    same(Q["op9_pii"](spark, ""), brute.pii(odd))
    assert any("term" in x[-1] for x in brute.pii(odd))
    out = pii.sanitise(docs)
    assert out.schema == docs.schema and got(out, "doc_id", "text") == sorted(
        [(d, t) for (d, _), t in zip(odd, brute.sanitised(odd), strict=True)], key=repr)


def test_terms_beside_very_many_entities(spark):
    """Two documents with 2,000 addresses and 3,000 words each: no row for each pair of the two."""
    page = " ".join(f"10.0.{i // 250}.{i % 250} word{i}" for i in range(2000)) + " " + " ".join(f"more{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, page), (2, page), *((i + 3, f"only this {i}") for i in range(500))], "doc_id long, text string")
    found = pii.cut(pii.find(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "entities")
    groups, entities = pii.entity_groups(found.where(F.size("base") > 0), 502)
    assert entities == 2000 and groups.count() == 2
    # 2,000 times 5,000 pairs are tested: that two rows hold both may be chance
    assert pii.sanitised_spans(docs).agg(F.sum(F.size("spans"))).first()[0] == 2 * 2000


def test_quality_rules(spark, rows, frame):
    odd = HAZARDS + [(40, "one two three four five six seven eight nine " * 3), (41, "line a\nline b\nline a\n \n \n#|<" * 2)]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert got(Q["op10_quality_rules"](spark, SF), *names) == sorted([(d, *brute.quality(t)) for d, t in rows], key=repr)
    frame(odd)
    assert got(Q["op10_quality_rules"](spark, ""), *names) == sorted([(d, *brute.quality(t)) for d, t in odd], key=repr)


def test_compression_bands():
    import base64

    import zstandard
    zstd = zstandard.ZstdCompressor(level=quality_rules.ZSTD_LEVEL, write_content_size=False)
    r = random.Random(2)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(2000))
    noise = base64.b85encode(r.randbytes(9000)).decode()
    dull = " ".join(f"item{i % 7} costs {i % 3} and {i}" for i in range(2000))
    middle = prose + " " + " ".join(f"{i} dull dull" for i in range(1200))
    assert quality_rules.judge(prose, zstd)[-3] is None
    spaced = " ".join(noise[i:i + 40] for i in range(0, len(noise), 40))
    assert quality_rules.judge(spaced, zstd)[-3] == "incompressible"
    assert quality_rules.judge(dull, zstd)[-3] == "repetitive"
    assert quality_rules.judge(middle, zstd)[-3] == "chunks"


@pytest.mark.parametrize("name", list(Q))
def test_empty_tables(spark, frame, name):
    frame([], {"benchmark": ([], "item_id long, text string"), "conversations": ([], "conv_id long, turn long, role string, text string")})
    assert Q[name](spark, "").collect() == []
