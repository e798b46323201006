"""Templates inside longer matches of other templates."""

import random

from docstrata.llm import license

NESTED = b"licensed under the apache license version 2 0 the license".split()


def test_nested_template_is_whole():
    scanner = license.Scanner()
    _, spans, score = scanner.scan(NESTED)
    assert score == 1.0 and (0, 8, "apache-2", 1.0) in [(s, e, scanner.labels[n], c) for s, e, n, c in spans if n >= scanner.n_base]


def test_nested_label_without_base_phrase():
    scanner = license.Scanner(base=(("zz yy xx", "none"),), templates=(("short", "b c d e"), ("long", "a b c d e f g h i j k l m n")))
    _, spans, score = scanner.scan(b"x a b c d e f g x".split())
    assert [scanner.labels[n] for _, _, n, _ in spans] == ["short"] and score == 1.0


def test_pieces_are_the_maximal_matches():
    rng = random.Random(6)
    for _ in range(30):
        draw = lambda n: [rng.choice("abc") for _ in range(n)]
        templates = [draw(rng.randint(3, 14)) for _ in range(4)]
        scanner = license.Scanner(base=(("z z z", "none"),), templates=tuple((str(k), " ".join(t)) for k, t in enumerate(templates)))
        words = draw(60)
        text = [w.encode() for w in words]
        want = set()
        for number, t in enumerate(templates, 1):
            for i in range(len(words)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    if n >= 3 and not (i and j and words[i - 1] == t[j - 1]):
                        want.add((number, i, j, n))
        got = scanner.pieces(text, scanner.automaton.statistics(text, scanner.least))
        assert set(got) == want and len(got) == len(want)
