import random

#: Columns of the documents table, and others whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, node string, k long, h long, found string, root string, u string, v string"


def documents(spark, rows):
    """A table of (doc_id, text) with all other columns filled."""
    full = [(i, t, "en", "s", len(t or ""), 0.5, True, "n", 1, 2, "f", "r", "u", "v") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


#: Null and empty texts, a repeated row, a null id, equal texts, white space alone.
EDGES = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a  b"), (4, "a\t\nb"), (5, " \n "), (6, " "), (7, "naïve Ünï 日本 x")]


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def prose(seed, n):
    return " ".join(words(random.Random(seed), n))


def union(pairs, nodes):
    """node -> least node of its component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
