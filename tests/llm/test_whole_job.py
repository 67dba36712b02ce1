"""Cases that the operators once left undone."""

from __future__ import annotations

import random
import string

import pytest
import zstandard

from tillbook.llm import chunk_dedup, pii, quality_rules


def test_terms_far_from_their_entity(spark):
    """A term of any length is sanitised in all documents, however far from the entity, and copies count."""
    far = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"Li {far} {i} mail bob@x.org") for i in range(3)] + [(3, "here Li is alone")]
    rows += [(10 + i, "Oy the same text, ann@y.org") for i in range(4)]
    rows += [(20, "once only cat@z.org")]
    rows += [(100 + i, f"{far} mail the same text, once only, filler{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert all(out[i] == f"[TERM] {far} {i} mail [EMAIL]" for i in range(3))
    assert out[3] == "here [TERM] is alone"
    assert all(out[10 + i] == "[TERM] the same text, [EMAIL]" for i in range(4))
    assert out[20] == "once only [EMAIL]"
    assert all(out[i] == t for i, t in rows if i >= 100)


def noise(r, alphabet, n):
    """``n`` bytes of random words, 20 at least."""
    text = [r.choice(alphabet) for _ in range(n)]
    for i in range(0, n, max(2, min(7, n // 22))):
        text[i] = " "
    return "".join(text)


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(33, 127))), string.ascii_letters + string.digits + "+/"])
def test_random_text_of_all_lengths(alphabet):
    r = random.Random(4)
    zstd = zstandard.ZstdCompressor(level=quality_rules.ZSTD_LEVEL, write_content_size=False)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 6))) for _ in range(6000))
    for n in (112, 128, 160, 192, 256, 384, 500, 1000, 2000, 4096, 8192, 20_000):
        assert quality_rules.judge(noise(r, alphabet, n), zstd)[-3] == "incompressible", n
        assert quality_rules.judge(prose[:n], zstd)[-3] is None, n
    one = quality_rules.judge(prose[:8192] + noise(r, alphabet, 4096) + prose[8192:16384], zstd)
    assert one[-4] == pytest.approx(0.2)


def test_passages_of_documents_with_shared_ids(spark):
    """One of the documents without an id, or of one id, keeps what they share; repeated rows stay one document."""
    r = random.Random(6)

    def words(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))

    none, same = words(90), words(90)
    rows = [(None, f"{words(20)} {none} {words(20)}") for _ in range(4)] + [(5, f"{words(20)} {same} {words(20)}") for _ in range(3)]
    rows += [rows[0], rows[-1], (6, words(90)), (6, words(90))]
    out = chunk_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    result = {}
    for x in out:
        result.setdefault((x.doc_id, x.kept[:20]), set()).add((x.n_removed, x.kept))
    assert len(out) == len(rows) and all(len(x) == 1 for x in result.values())
    gone = {d: sorted(n for (e, _), x in result.items() if e == d for n, _ in x) for d in (None, 5, 6)}
    assert [n > 0 for n in gone[None]] == [False, True, True, True]
    assert [n > 0 for n in gone[5]] == [False, True, True]
    assert not any(gone[6])
