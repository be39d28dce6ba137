"""A small labelled table for the field: personal data that the patterns leave out, and look-alikes.

Rows come from forms and carrier sentences by a rule: digits and names are drawn with a seed, so
two seeds and two halves of the sentences give a table to train on and one to measure with.
"""

from __future__ import annotations

import random
import re

#: Spellings of a kind that its pattern doesn't read. N is a name, D a digit, other text itself.
FORMS = {
    "email": ["N [at] N [dot] org", "N (at) N (dot) com", "N[at]N.net", "N(at)N.org", "N.N [at] N [dot] com", "N{at}N.com"],
    "ip": ["DD[.]DD[.]DD[.]DD", "1DD[.]DD[.]D[.]DD", "1DD[.]D[.]D[.]DD"],
    "phone": ["(DDD) DDD-DDDD", "DDD-DDD-DDDD", "0DDD/DDDDDDD", "0DD/DDDDDDDD", "(0DD) DDDDDDDD", "DDD-DDDD-DDDD"],
}
#: Look-alikes: dates, times, years, versions, prices, book and order numbers, code, remarks.
NOTHING = [
    "19DD-0D-1D", "1D/0D/20DD", "1D:DD:DD", "19DD-20DD", "D.D.DD", "$D,DDD.DD", "D,DDD,DDD", "978-D-DD-DDDDDD-D", "#DDDDDD",
    "DDD/DDD", "N[i]", "N(x)", "(N)", "[N]", "N (N) N", "N [N] N", "DDDDDDDD", "D.DDDDDDDD", "NDDDDD", "DD%", "DD-DD", "N-DDDD",
    "(DDDD)", "(D) N", "[D]", "D[a]", "(DDD) N", "DDD-DDD", "DDDD-DDDD", "0.DDD", "D (DD) DDD",
]
CARRIERS = [
    "X", "please write to X before noon", "the number is X and it was noted", "see X", "X was given in the letter",
    "contact: X", "we reached them at X, as always", "in short X.", "It says X on the second page of the report",
    "Office X or come by", "they wrote X and left", "Note X here",
]
NAMES = "anna jonas mira peter smith lopez garden river office support shop mail news team info".split()


def examples(seed: int, carriers: list[str] = CARRIERS, each: int = 6) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Rows (text, spans): each form and look-alike ``each`` times, spans as (start, stop, kind)."""
    rng = random.Random(seed)

    def drawn(form: str) -> str:
        return re.sub("[ND]", lambda m: rng.choice(NAMES) if m[0] == "N" else rng.choice("123456789"), form)

    table = []
    for kind, forms in [*FORMS.items(), ("", NOTHING)]:
        for form in forms:
            for _ in range(each):
                before, after = rng.choice(carriers).split("X")
                value = drawn(form)
                span = (len(before), len(before) + len(value), kind)
                table.append((before + value + after, [span] if kind else []))
    return table
