"""Proposals inside runs of digits."""

import pytest

from editpulse.llm import pii_spans


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("(555) 123-4567 (555) 987-6543", {("phone", "(555) 123-4567"), ("phone", "(555) 987-6543")}),
        ("4111 1111 1111 1111 12/27", {("card", "4111 1111 1111 1111")}),
    ],
)
def test_parts_of_a_run(text, expected):
    found = {(s.kind, text[s.start : s.end]) for s in pii_spans.proposed_spans(text)}
    assert expected <= found
    base = pii_spans.base_spans(text)
    assert not base and expected <= {(c["kind"], text[c["start"] : c["end"]]) for c in pii_spans.candidates(text, base)}


def test_spelled_address_of_any_length():
    text = "write to " + "a.b" * 400 + " [at] x.org now"
    assert [text[s.start : s.end] for s in pii_spans.proposed_spans(text)] == ["a.b" * 400 + " [at] x.org"]
