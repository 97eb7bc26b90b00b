import re

LOW = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (900001, None), (900002, ""), (900003, "   \n\t "), (900004, "one"), (900005, "one two"), (900006, "ONE Two"), (900007, "É é İ ſ K   x"), (900008, "a" * 70000), (900009, "word " * 30000),
    (900010, "same text here twice over and over again so that it is long enough"), (900011, "same text here twice over and over again so that it is long enough"), (900012, "...!!! ???"), (900012, "repeated id"), (900013, "\x00\x01 nul \x7f end"),
    (900014, "日本語 の 文章 です " * 5), (None, "no id at all but a text"), (900015, "<|endoftext|> in  the   text <|endoftext|>"),
]


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOW))


def with_edges(spark, sf):
    """All documents of a folder and the edge cases, with columns besides whose names clash with the operators' own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in EDGES], SCHEMA)
    out = docs.union(more)
    for c in ("id", "head", "score", "label", "spans", "curve", "band", "component", "a", "b", "count", "n_words", "text_", "model"):
        out = out.selectExpr("*", f"'x' as {c}")
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return root
