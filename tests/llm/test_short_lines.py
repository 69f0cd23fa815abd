import random

from sparkdem.llm import lines
from tests.llm.test_lines import grouped
from tests.llm.test_toxicity import distance


def test_short_lines_one_edit_apart_are_joined(spark):
    """All pairs of lines of up to 80 characters, compared by their distances."""
    rng = random.Random(5)
    letters, short = "abcdefghij é🙂", []
    for _ in range(60):
        base = "x" + "".join(rng.choice(letters) for _ in range(rng.randrange(5, 78))) + "y"
        short.append(base)
        for _ in range(rng.randrange(3)):  # one to three edits away
            line = list(base)
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(1, len(line) - 1)
                line[a : a + rng.randrange(2)] = rng.choice(["", "q", "a"])
            short.append("".join(line))
    short += ["Thwhesnd esator ...", "Thwhesnd, esator ...", "a line!", "a lime!", "12345678", "1234567"]
    texts = sorted(set(short))
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            x, y = ({t[k : k + 8] for k in range(len(t) - 7)} for t in (a, b))
            if x and y and (len(x & y) >= 0.8 * len(x | y) or abs(len(a) - len(b)) < 2 and distance(a, b) == 1):
                root[find(a)] = find(b)
    first = {}
    for d, t in enumerate(short):
        first.setdefault(find(t), (d, 0))
    want = {(d, 0): (first[find(t)], first[find(t)] == (d, 0)) for d, t in enumerate(short)}
    got = grouped(lines.line_components(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")).collect())
    assert got == want and sum(not kept for _, kept in want.values()) > 15
    assert got[short.index("Thwhesnd, esator ..."), 0][0] == (short.index("Thwhesnd esator ..."), 0)
