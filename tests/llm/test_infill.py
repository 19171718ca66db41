import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.texts import TEXTS, docs

from pulsegrid.llm.infill import Rules, boundaries, cut, decode, fill_in_middle, restore

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"(?s)."}


def by_regex(doc_id, text, rules=Rules()):
    """The same cut from a list of matched units."""
    text = text or ""
    units = re.findall(UNITS[rules.unit], text)
    n = len(units)
    digest = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in (rules.prefix, rules.suffix, rules.middle)) or h3 % 100 >= rules.rate:
        return n, "plain", None, None, text
    lo, hi = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < rules.spm:
        return n, "spm", len(p), len(m), f"{rules.suffix}{s}{rules.prefix}{p}{rules.middle}{m}"
    return n, "psm", len(p), len(m), f"{rules.prefix}{p}{rules.suffix}{s}{rules.middle}{m}"


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_boundaries_are_those_of_matched_units(unit):
    for text in ("", "\n", "\n\n", "a", "a\n", "\na", "a\n\n b\t\tc\r\nd", "日本\n語 \U0001f600\n", "x" * 1000 + "\n" * 1000):
        ends, at = [0], 0
        for u in re.findall(UNITS[unit], text):
            at += len(u)
            ends.append(at)
        assert boundaries(decode(text.encode()), unit).tolist() == ends


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<PSM>\n é\U0001f600", max_size=40), st.integers(-5, 10**12), st.sampled_from(sorted(UNITS)))
def test_cut_equals_regex_and_is_restored(text, doc_id, unit):
    rules = Rules(unit=unit, rate=80, spm=40)
    n, form, before, between, out = cut(text.encode(), doc_id, rules)
    assert (n, form, before, between, out.decode()) == by_regex(doc_id, text, rules)
    assert restore(out, form, rules) == text.encode()


def test_rows_of_every_kind(spark):
    table = docs(spark)
    got = fill_in_middle(table).collect()
    assert len(got) == len(TEXTS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *by_regex(i, t)[:4], sha(by_regex(i, t)[4]), sha(t or "")) for i, t in TEXTS), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got), key=str) == want
    assert {bytes(r.output) for r in got} == {by_regex(i, t)[4].encode() for i, t in TEXTS}
    assert fill_in_middle(docs(spark, [])).collect() == []


def test_sentinels_keep_a_text_plain(spark):
    rows = [(k, f"one\ntwo {mark} three\nfour") for k, mark in enumerate(("<P>", "<S>", "<M>", "<p>", "<PP>"))]
    got = {r.doc_id: r for r in fill_in_middle(docs(spark, rows), output=False).collect()}
    assert [got[k].form == "plain" for k in range(5)] == [True, True, True, False, False]
    assert "output" not in got[0].asDict() and got[0].n == 3 and got[0].prefix_chars is None


def test_a_very_long_text_and_bytes_that_are_not_text():
    text = "".join(f"line {k} of many\n" for k in range(100_000))
    n, form, before, between, out = cut(text.encode(), 12)
    assert (n, form, before, between, out.decode()) == by_regex(12, text) and restore(out, form).decode() == text
    raw = b"\xff\xfe a\nb\x80\n\xc3\nd"
    n, form, _, _, out = cut(raw, 3)
    assert n == 4 and form != "plain" and restore(out, form) == raw
