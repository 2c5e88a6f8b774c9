"""Small document tables that hold the awkward cases."""

import random

ROWS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, node string, c0 int, shard double"


def word(r, n=6):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, n)))


def documents(seed=1, n=60):
    r = random.Random(seed)
    prose = [" ".join(word(r) for _ in range(r.randint(12, 90))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(prose)]
    base = prose[3].split()
    for k in range(12):  # near copies
        w = list(base)
        w[r.randrange(len(w))] = word(r)
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, prose[5]) for k in range(15)]  # exact copies
    rows += [(300 + k, f"Common Line.\n{prose[k]}\n  common line. \n") for k in range(14)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "One"), (404, "one two"), (405, "ONE TWO"), (None, prose[7]), (None, None), (406, prose[9] + " É œ 漢字 \x00\x1f"), (7, prose[7]), (7, prose[7])]
    rows.append((500, " ".join(word(r) for _ in range(30_000))))
    rows.append((501, "x" * 70_000 + "\n" + "same line " * 20 + "\n" + "same line " * 20))
    r.shuffle(rows)
    return [(i, t, r.choice(["aa", "bb", None]), r.choice(["s0", "s1", None]), len(t or ""), "clash", None, None, None) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, ROWS).repartition(3)


def key(rows):
    return sorted(rows, key=repr)
