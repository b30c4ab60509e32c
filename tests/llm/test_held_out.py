"""Recall and precision on notices, prompts, slots and filler that were not taken from the tables."""

import held_out
import pytest

from seqjoin.llm.notices import classify
from seqjoin.llm.residue import scan_text

KINDS = ["ERROR_PAGES", "SCRIPTS_REQUIRED", "PROMPTS", "SLOTS", "FILLER"]


def flagged(text):
    own, messages = scan_text(text)
    return bool(own) or any(alone and classify(m) for m, alone in messages.items())


@pytest.mark.parametrize("kind", KINDS)
def test_recall(kind):
    lines = getattr(held_out, kind)
    found = sum(map(flagged, lines))
    print(f"{kind}: {found} of {len(lines)}")
    assert found >= 0.85 * len(lines)


def test_recall_and_precision_over_all():
    lines = [x for k in KINDS for x in getattr(held_out, k)]
    found, wrong = sum(map(flagged, lines)), sum(map(flagged, held_out.ORDINARY))
    print(f"recall {found / len(lines):.3f}, precision {found / (found + wrong):.3f}, ordinary flagged {wrong} of {len(held_out.ORDINARY)}")
    assert found >= 0.9 * len(lines) and found >= 0.95 * (found + wrong)
