"""Numbers of a line's shingles are equal exactly where the shingles are, for few and for many different characters."""

import random

from kinelattice.llm.line_dedup import WIDTH, _distinct, numbered_line_shingles


def test_numbers_tell_shingles_apart():
    rng = random.Random(5)
    wide = [chr(0x4E00 + k) for k in range(4000)] + ["\U0001f600"]
    for letters, least in (("ab ", 1), (wide, 1), ("abc", 0)):
        lines = ["".join(rng.choices(letters, k=rng.randint(least, 14))) for _ in range(300)]
        want = [[x[k : k + WIDTH] for k in range(len(x) - WIDTH + 1)] or [x] for x in lines]
        numbers, n = numbered_line_shingles([x.encode() for x in lines])
        if least:
            assert n.tolist() == [len(w) for w in want]
            flat = [s for w in want for s in w]
            assert len(set(flat)) == len(set(numbers.tolist())) == len(set(zip(flat, numbers.tolist())))
            _, m = _distinct(numbers, n)
            assert m.tolist() == [len(set(w)) for w in want]
