import random

from siftspark.llm.spans import apart


def test_apart_equals_comparing_with_all():
    r = random.Random(4)
    for _ in range(400):
        spans = [(r.randrange(3), a := r.randrange(30), a + r.randrange(1, 8)) for _ in range(r.randrange(12))]
        taken = []
        for p, a, b in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
            if all(b <= c or d <= a for _, c, d in taken):
                taken.append((p, a, b))
        assert apart(spans) == sorted(taken, key=lambda s: s[1])
    assert apart([]) == []
