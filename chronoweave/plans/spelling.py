"""Misspelt words of time, and whether a question is about what was or what will be."""

from __future__ import annotations

import re

from chronoweave.plans.temporal import MONTHS, WEEKDAYS

#: Fixed values.
TIME_WORDS = [*MONTHS, *WEEKDAYS, "today", "yesterday", "tomorrow", "weekend", "week", "month", "hour", "morning", "evening", "last"]
PAST_WORDS = (
    "was were did had went felt met saw spent worked watched walked talked looked checked called cooked cleaned visited"
    " finished completed enjoyed managed built wrote browsed searched happened"
).split()
MODALS = ["should", "could", "would", "might", "must", "shall", "will", "can"]
WISHES = ["going", "want", "wants", "plan", "hope", "hoping", "planning", "intend", "wish"]
HEDGES = ["wondering", "thinking", "hoping", "planning", "going", "gonna", "about"]
REQUESTS = (
    "see know check review look get have find view recall remember tell show give summarize summarise pull fetch list"
).split()
PERSONS = ["i", "we", "you", "he", "she", "they"]
LEAST_LENGTH = 4


def damerau(a: str, b: str) -> int:
    """How many letters to put in, take out, replace or swap with their neighbour, to make ``b`` of ``a``."""
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}  # the last row of each letter
    for i, x in enumerate(a, 1):
        row, met = [far, i], 0  # met: the last column of this row with the same letter
        for j, y in enumerate(b, 1):
            swap = rows[seen.get(y, 0)][met] + (i - seen.get(y, 0)) + (j - met) - 1
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
            if x == y:
                met = j
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


def budget(word: str) -> int:
    """How many edits a word of time may be away: 1 to four letters, 2 to eight, else 3."""
    return 1 if len(word) <= 4 else 2 if len(word) <= 8 else 3


def corrected(text: str, keep: tuple[str, ...] = ()) -> str:
    """``text`` with misspelt words of time, and cues of tense one edit away, replaced by the one nearest word.

    A word stays that is known, one of ``keep``, shorter than four letters, or as near to two words.
    """
    cues = [w for w in PAST_WORDS + MODALS + WISHES if len(w) > LEAST_LENGTH]
    known = {*TIME_WORDS, *PAST_WORDS, *MODALS, *WISHES, *REQUESTS, *keep}
    out = []
    for word in text.split():
        plain = word.strip(".,?!:;").lower()
        near: list[tuple[int, str]] = []
        if len(plain) >= LEAST_LENGTH and plain not in known:
            for most, targets in ((budget(plain), TIME_WORDS), (1, cues)):
                near += [(n, w) for w in targets if abs(len(w) - len(plain)) <= most and (n := damerau(plain, w)) <= most]
        best = min(near, default=None)
        alone = best is not None and sum(n == best[0] for n, _ in near) == 1
        out.append(best[1] if alone else word)
    return " ".join(out)


def tense(text: str) -> str | None:
    """``past``, ``future`` or None. Regret comes first, then the past without hedges, then plans.

    A modal or a wish before a verb of asking ("should I check ...") is a request and tells nothing.
    """
    words = re.findall(r"[a-z]+(?:'[a-z]+)?", text.lower().replace("'ve", " have").replace("'ll", " will"))
    ahead = lambda k, n=1: words[k + n] if k + n < len(words) else ""
    for k, word in enumerate(words):
        if word in MODALS and (ahead(k, 2) if ahead(k) in PERSONS else ahead(k)) in ("have", "of") and word != "will":
            if ahead(k, 3 if ahead(k) in PERSONS else 2) not in ("a", "to", "the"):
                return "past"
    plain = [w for k, w in enumerate(words) if not (w in ("was", "were") and ahead(k) in HEDGES)]
    if set(plain) & set(PAST_WORDS) or re.search(r"\b(have|has) (\w+ )?been\b", " ".join(plain)):
        return "past"
    for k, word in enumerate(words):
        asked = [w for w in words[k + 1 :] if w not in (*PERSONS, "like", "love", "to")][:1]
        person = ahead(k) in ("i", "we") or (k and words[k - 1] in ("i", "we"))
        if word in ("gonna", "wanna", "gotta") or (word in WISHES and ahead(k) == "to" and asked and asked[0] not in REQUESTS):
            return "future"
        if word in MODALS and person and asked and asked[0] not in (*REQUESTS, "not"):
            return "future"
    return None
