"""Fill-in-middle: outputs against a plain string version, exact round trips."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import ROWS, documents, with_clashes

from photarium.llm import fill_middle


def plainly(doc_id, text, rate=100, spm=50, seed=7):
    """The same by string slicing."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in df.collect())


MARKS = [
    (20, "one\ntwo <P> three\nfour", "en", "a", 1), (21, "<<S", "en", "a", 1), (22, "a<S\n>b<\nM>c<P\n>", "en", "a", 1), (23, "<M>", "en", "a", 1),
    (24, "\n\n\n", "en", "a", 1), (25, "é\n漢字\n😀\nend", "en", "a", 1), (26, "x<", "en", "a", 1), (27, "P>y\n", "en", "a", 1), (28, "<P", "en", "a", 1),
    (29, ">z", "en", "a", 1), (30, "line of text\n" * 30_000, "en", "a", 1),
]


@pytest.mark.parametrize("window", [1, 7, fill_middle.WINDOW])
@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (100, 100)])
def test_outputs_are_those_of_slicing(spark, window, rate, spm, monkeypatch):
    rows = [r for r in ROWS + MARKS if window > 1_000 or len(r[1] or "") < 1_000]
    if window < 1_000:  # in this process, where the smaller window holds
        monkeypatch.setattr(fill_middle, "WINDOW", window)
        texts = [t or "" for _, t, *_ in rows]
        data, starts = fill_middle._bytes_of(pa.array(texts))
        expected = [plainly(i, t, rate, spm) for i, t, *_ in rows]
        form = np.array([fill_middle.FORMS.index(e[1]) for e in expected])
        lengths = [[len((t or "")[:p or 0].encode()), len((t or "")[:(p or 0) + (m or 0)].encode())] for (_, t, *_), (_, _, p, m, _) in zip(rows, expected)]
        cuts = np.array(lengths) + starts[:-1, None]
        out, out_starts = fill_middle.rearrange(data, starts, form, cuts)
        assert [bytes(out[a:b]).decode() for a, b in zip(out_starts, out_starts[1:])] == [e[4] for e in expected]
        back, back_starts = fill_middle.restore_all(out, out_starts, form)
        assert [bytes(back[a:b]).decode() for a, b in zip(back_starts, back_starts[1:])] == texts
        return
    found = fill_middle.transform(documents(spark, rows), rate=rate, spm=spm)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert rows_of(found) == Counter((i, *plainly(i, t, rate, spm)) for i, t, *_ in rows)
    restored = fill_middle.restore(found).collect()
    assert Counter((r["doc_id"], r["restored"]) for r in restored) == Counter((i, t or "") for i, t, *_ in rows)


@given(st.lists(st.tuples(st.integers(0, 10**6), st.text(alphabet="ab\n<>PSMé", max_size=30)), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_batches_of_any_texts(rows):
    hashes = [[int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[k:k + 8], 16) for i, _ in rows] for k in range(0, 32, 8)]
    batch = pa.RecordBatch.from_pydict(
        {"row": [{"doc_id": i} for i, _ in rows], "text": [t for _, t in rows], **{f"h{k + 1}": h for k, h in enumerate(hashes)}}
    )
    out = list(fill_middle._transform(100, 50)(iter([batch])))
    found = [r for b in out for r in b.to_pylist()]
    assert [(r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found] == [plainly(i, t) for i, t in rows]
    back = [r["restored"] for b in fill_middle._restore(iter(out)) for r in b.to_pylist()]
    assert back == [t for _, t in rows]


def test_clashes_and_empty_table(spark):
    names = ["row", "h1", "h2", "n", "form", "output", "restored", "prefix_chars", "middle_chars", "none"]
    found = fill_middle.restore(fill_middle.transform(with_clashes(documents(spark), *names)))
    assert sorted(found.columns) == sorted({"doc_id", "lang", "source", "n_chars", *names})
    assert Counter((r["doc_id"], r["restored"], r["h1"]) for r in found.collect()) == Counter((i, t or "", "clash of h1") for i, t, *_ in ROWS)
    assert fill_middle.digest(documents(spark, [])).count() == 0


def test_digest(spark):
    found = fill_middle.digest(documents(spark, MARKS)).collect()
    for r in found:
        text = next(t for i, t, *_ in MARKS if i == r["doc_id"])
        assert r["output_sha256"] == hashlib.sha256(plainly(r["doc_id"], text)[4].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
