import random

#: Columns whose names the operators use inside; they must pass through or be ignored.
EXTRA = "w double, size int, key string, score double, node long, root long, taken long, _x string, rank int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text[, source])."""
    out = []
    for r in rows:
        d, t, s = (*r, "src")[:3]
        out.append((d, t, "en", s, len(t) if t is not None else None, *((1.5, 7, "k", 0.5, 1, 2, 3, "x", 9) if extra else ())))
    return spark.createDataFrame(out, SCHEMA if extra else DOCUMENTS)


def corpus(seed=3):
    """Plain, copied, nearly copied, empty, null, long and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(20, 200))) for i in range(60)]
    base = words(rng, 150).split()
    rows += [(100 + i, " ".join(base)) for i in range(5)]
    for i in range(8):
        near = list(base)
        near[10 + 3 * i] = "changed"
        rows.append((110 + i, " ".join(near)))
    passage = words(rng, 60)
    rows += [(130 + i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(6)]
    rows += [(150, None), (151, ""), (152, " \n "), (153, "one two"), (154, words(rng, 30000)), (155, "again " * 300), (156, "Ünïcödé ß 漢字 " * 40)]
    rows += [(0, rows[0][1]), (100, rows[60][1]), (None, words(rng, 40)), (None, None)]
    return rows
