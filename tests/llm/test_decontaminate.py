import random

from corpusgraph.llm import decontaminate as D


def words(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "ing", "é", "st", "nd"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def distance(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        old, row[0] = row[:], row[0] + 1
        for j, y in enumerate(b, 1):
            row[j] = min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(r, text, n):
    t = list(text)
    for at in sorted(r.sample(range(len(t)), n), reverse=True):
        kind = r.randrange(3)
        if kind == 0:
            t[at] = "q"
        elif kind == 1:
            del t[at]
        else:
            t.insert(at, "z")
    return "".join(t)


def setup(seed=1):
    r = random.Random(seed)
    items = [(i, words(r, n) + ".") for i, n in enumerate([12, 18, 30, 60, 25, 40])]
    docs = [None, "", "x", words(r, 20), words(r, 3000)]
    for _, text in items:
        docs.append(words(r, 50) + " " + text + " " + words(r, 50))
        docs.append(text.upper().replace(" ", "!!\n") + "!!")
        docs.append(words(r, 30) + "\n" + edited(r, text, 2) + " " + words(r, 30))
        docs.append(words(r, 30) + " " + edited(r, text, len(text) // 3) + " " + words(r, 30))
        docs.append(words(r, 9) + " " + text[: len(text) // 5] + " " + words(r, 9))
    return items, docs


def test_passages_match_brute_force(spark, docs):
    """A document is found if and only if a passage aligns within its budget."""
    items, texts = setup()
    items += [(90, None), (91, "too short")]
    got = {r.doc_id for r in D.contaminated(docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    p = D.passages(items)
    want = set()
    for d, t in enumerate(texts):
        c = D.normal(t or "")[0].tolist()
        if len(c) < 4000 and any(distance(p.chars[k, : p.length[k]].tolist(), c) <= p.edits[k] for k in range(len(p.item))):
            want.add(d)
    assert got == want and len(want) >= 18


def test_spans_and_blocks(spark, docs, monkeypatch):
    items, _ = setup()
    text = "AB. " + items[3][1] + " tail"
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contaminated(docs([text, text]), frame).collect()
    assert {(r.doc_id, r.item_id, r.start, text[r.start : r.stop], r.edits) for r in rows} == {(d, 3, 4, items[3][1][:-1], 0) for d in (0, 1)}
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert sorted(D.contaminated(docs([text, text]), frame).collect()) == sorted(rows)


def test_clean_keeps_rows_and_columns(spark, docs):
    items, texts = setup()
    frame = spark.createDataFrame(items, "item_id long, text string")
    d = docs([texts[5], "clean text", None]).union(docs(["clean text"], start=1))
    kept = D.clean(d, frame)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2]
    assert D.contaminated(d, frame.limit(0)).collect() == [] == D.contaminated(d.limit(0), frame).collect()


def test_short_items_are_found(spark):
    """Items of one q-gram and more: without edits where an edit would leave no gram, with one where it would."""
    items = ["twelve chars", "a passage of twenty-2", "thirty one characters in a row.", "too short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are Twelve Chars, and more"), (2, "with a passage of twenty-2 inside"), (3, "see thirty one charXcters in a row here"), (4, "it is too short to be looked for"), (5, "nothing of this at all"), (6, "a passage of twenXy-2")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 0, 0), (2, 1, 0), (3, 2, 1)}
