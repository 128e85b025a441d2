import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import alignment
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def aligner():
    return alignment._loaded(alignment.TOKENIZERS, alignment.A_FILE, alignment.B_FILE)


def plain_tokens(aligner, text):
    """Token lists by the tokenizers' own libraries, None where they don't spell the text."""
    if not text:
        return None
    whole = (" " + text).encode()
    a = aligner.a.plain.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.model.encode(text)
    for ids, values in ((a, aligner.a.bytes), (b, aligner.b.bytes)):
        if b"".join(values[i] for i in ids) != whole:
            return None
    return a, b


def plain(aligner, texts):
    """The contract by nested loops."""
    rows, counts = [], Counter()
    for text in texts:
        found = plain_tokens(aligner, text)
        links, groups = [], []
        if found:
            spans = []
            for ids, values in zip(found, (aligner.a.bytes, aligner.b.bytes), strict=True):
                at, out = 0, []
                for i in ids:
                    out.append((at, at + len(values[i]), i))
                    at += len(values[i])
                spans.append(out)
            links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
            cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
            low = 0
            for high in cuts:
                groups.append("|".join(",".join(str(x[2]) for x in side if low < x[1] <= high) for side in spans))
                low = high
        counts.update(set(links))
        rows.append((found, links, groups))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for found, links, groups in rows:
        sides = found or ([], [])
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""
        out.append((len(sides[0]), len(sides[1]), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links),
                    sum(counts[x] for x in links), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "a", "  two  spaces ", "<|endoftext|> and </s><s>", "<0x0A>\n\t", "naïve café 北京 🙂", "▁odd▁mark", "x" * 3000,
    " " * 25000 + "b", "same text", "same text", "ﬁ ligature   　", "a\x00b", "é",
]


@pytest.mark.parametrize("block", [alignment.BLOCK, 300])
def test_odd_texts_against_plain(spark, docs, aligner, block):
    rows = docs(*[(None if k == 3 else k % 9, t, "s") for k, t in enumerate(ODD)])
    got = alignment.align(rows, block=block).collect()
    want = plain(aligner, ODD)
    names = [None if k == 3 else k % 9 for k in range(len(ODD))]
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == Counter((i, *w) for i, w in zip(names, want, strict=True))


def test_documents_against_plain(spark, aligner):
    given_rows = [r for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"]) < 4000][:60]
    rows = spark.createDataFrame(given_rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(rows, block=5000).collect()}
    want = plain(aligner, [r["text"] for r in given_rows])
    assert got == {r["doc_id"]: w for r, w in zip(given_rows, want, strict=True)}


def test_no_rows_and_clashing_columns(spark, docs):
    assert alignment.align(docs()).count() == 0
    rows = docs((1, "some text", "s")).withColumnsRenamed({"n_chars": "n_a", "score": "block"})
    assert alignment.align(rows).columns == ["doc_id", *COLUMNS]


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_fast_encoder_equals_the_file_s_own(text):
    a = alignment._loaded(alignment.TOKENIZERS, alignment.A_FILE, alignment.B_FILE).a
    assert a.encode(" " + text) == a.plain.encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.data())
def test_pointers_end_at_common_ends(lengths, data):
    total = sum(lengths)
    cuts = sorted(data.draw(st.sets(st.integers(1, total))) | {total})
    end_a, end_b = np.cumsum(lengths), np.array(cuts)
    terminal = alignment.jump(alignment.farthest(end_a, end_b))
    common = np.intersect1d(end_a, end_b)
    ends = np.concatenate([end_a, end_b])
    assert (ends[terminal] == common[np.searchsorted(common, ends)]).all()


def test_planes_round_trip(aligner):
    pairs, times = np.array([0, 5, 1_600_000_000]), np.array([1, 300, 70_000])
    back = aligner.unpack(*aligner.pack(pairs, times))
    assert (back[0] == pairs).all() and (back[1] == times).all()
