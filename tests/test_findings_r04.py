"""Cases of the fourth review: part_audit against its SQL on documents written here."""

import random

import pytest

from sluicework.operators import parts
from sluicework.operators.chunking import windows

from .test_findings_r03 import against_sql  # noqa: F401

#: Sentences of 300 and 201 characters: every window goes back to the seam that moves on least.
DENSE = "".join(f" {'x' * (n - 2)}." for n in [300, 201] * 11)[1:5300]


def test_a_line_of_many_windows_is_cut(against_sql):  # noqa: F811
    """Lines that have over eight windows alone: a whole document, behind and before others, and in longer lines."""
    assert len(windows(DENSE)) > 8
    texts = [DENSE, f"Some words.\n{DENSE}\n\nMore words.", "\n".join([DENSE] * 3), " ".join([DENSE] * 4), "z" * 15_000, "Few words."]
    got = against_sql("part_audit", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert len(got) == len(texts) and not got["over_band"].any()


def test_blank_lines_are_those_of_the_sql(against_sql):  # noqa: F811
    blank = [*" \t\r\f\v\x1c\x1d\x1e\x1f\x85\xa0"]
    said = [chr(c) for c in (0, 8, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x1F600)]
    lines = ["\r\n".join(blank + said), f"a\n{chr(0x301)}b\n{chr(0x1F600)}{chr(0x200D)}{chr(0x1F527)}\n", "", None]
    have = [(i, f"{c}\n\n{c} {c}") for i, c in enumerate(blank + said)] + list(enumerate(lines, 100)) + [(None, "no id")]
    got = against_sql("part_audit", documents=(have, "doc_id long, text string"))
    assert len(got) == len(said) + 3


def test_documents_under_one_id_have_no_gaps(against_sql):  # noqa: F811
    """Copies and other texts under one id, whose lines of equal numbers begin parts."""
    one = "\n".join(f"Line {i} has some words. " * (80 + 40 * (i % 3)) for i in range(12))
    have = [(1, one), (1, one), (1, one.upper()), (2, "z" * 9_000), (2, "z" * 9_000), (None, one), (None, one)]
    got = against_sql("part_audit", documents=(have, "doc_id long, text string"))
    assert not got["gaps"].any()


@pytest.mark.parametrize("seed", range(4))
def test_unit_cuts_are_seam_cuts_that_fit_alone(seed):
    rng, halved = random.Random(seed), 0
    for _ in range(40):
        text = "".join(f" {'x' * (n - 2)}." for _ in range(rng.randrange(1, 30)) for n in rng.choice([[300, 201], [300, 201], [50, 251, 200], [700], [9]]))
        cuts = parts.unit_cuts(text)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        assert all(a < z and len(windows(text[a:z])) <= 8 for a, z in cuts)
        assert {a for a, _ in parts.seam_cuts(text)} <= {a for a, _ in cuts}
        halved += len(cuts) > len(parts.seam_cuts(text))
    assert halved
