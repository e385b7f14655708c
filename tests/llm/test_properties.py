"""Properties that hold for any input."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clickloom.llm import _text, chat, decontam, warc
from clickloom.llm._text import SPACE_WORDS, hash_spans, shingles, slices, words_of

TEXT = st.text(alphabet=st.sampled_from("ab<s>/[INST]\\\nÉ漢 "), max_size=60)


@given(TEXT)
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_default_template_is_read_back(turns):
    formatted = chat.default_template(turns)
    assert chat.parse_default(formatted) == turns
    found = chat.render(turns)
    assert not found.rewrites and [chat.unescape(found.formatted[a:b]) for a, b in found.texts] == [t for _, t in turns]


@given(st.binary(max_size=400), st.integers(1, 50))
def test_chunked_framing_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


@given(st.integers(0, 9), st.binary(max_size=300), st.integers(60, 200), st.integers(1, 40))
def test_records_round_trip(page, payload, segment, chunk):
    records = list(warc.parse_records(warc.page_records(page, "u\r\nX: y", payload, None, "0.1", segment, chunk)))
    block = b"".join(b for _, b in records)
    assert warc.payload_of(block) == payload
    assert [int(f.get("warc-segment-number", 1)) for f, _ in records] == list(range(1, len(records) + 1))


@settings(deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é\t\n"), max_size=30), max_size=6))
def test_word_kernel_equals_splitting(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    low, starts, ends, first = words_of(data, at, SPACE_WORDS) if texts else (data, at[:0], at[:0], at)
    want = [t.lower().split() for t in raw]
    got = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for ws in want for w in ws]
    hashes = hash_spans(low, starts, ends)
    assert len(set(hashes.tolist())) == len(set(got))
    if texts:
        sets = list(shingles(hashes, first, 2))
        assert [len(s) for s in sets] == [len({tuple(ws[i : i + 2]) for i in range(max(1, len(ws) - 1))}) if ws else 0 for ws in want]
        assert [j for _, j in slices(at, 7)][-1] == len(texts)


@settings(deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=12), st.integers(1, 50))
def test_hashes_dont_depend_on_blocks(words, block):
    low = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]).astype(np.int64) - 1 if words else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in words], dtype=np.int64)
    whole = hash_spans(low, starts, ends)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(_text, "_BLOCK", block)
        assert hash_spans(low, starts, ends).tolist() == whole.tolist()


@given(st.binary(max_size=200), st.integers(1, 20))
def test_blocks_of_words_equal_whole_texts(text, block):
    numbers = {}
    get = lambda w, _: numbers.setdefault(w, len(numbers) + 1)
    assert decontam.word_numbers(text, get, block).tolist() == decontam.word_numbers(text, get).tolist()
