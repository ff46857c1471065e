"""Copies of a prompt with a changed word, wherever it stands."""

import random

import pytest

from talkweave.llm import pairs

WORDS = "could you tell me where my aunt left the keys of the boat".split()


@pytest.mark.parametrize("at", range(len(WORDS)))
def test_one_changed_word(at):
    assert pairs.is_copy(" ".join(WORDS), " ".join(WORDS[:at] + ["zebra"] + WORDS[at + 1 :]))


def test_first_words_new():
    assert pairs.is_copy(" ".join(str(n) for n in range(90)), " ".join(["so", "here", "it", "is", "as", "you", "gave", "me", *(str(n) for n in range(90))]))


def test_no_copies():
    assert not pairs.is_copy(" ".join(WORDS), "She left the keys of the boat with my other aunt in the harbour office.")
    assert not pairs.is_copy(" ".join(WORDS), " ".join(sorted(WORDS)))


def test_edits_against_table():
    pick = random.Random(7)
    for _ in range(300):
        a, b = ([pick.choice("abc") for _ in range(pick.randint(1, 9))] for _ in range(2))
        row = [*range(len(b) + 1)]
        best = row[-1]
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row, best = new, min(best, new[-1])
        assert pairs.edits(a, b) == best
