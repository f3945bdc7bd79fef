"""What a task of the suffix tree holds at once."""

from __future__ import annotations

from docloom.llm import suffix_tree


def test_occurrences_of_a_task():
    """Five buckets of 800,000 occurrences each passed 3000 MB of an executor with six Python workers."""
    assert suffix_tree.TURNS * suffix_tree.BUCKET <= 2_500_000
