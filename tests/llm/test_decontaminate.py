import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.llm import decontaminate as D

ITEM = "A train leaves at 9:30 and Alice pays 35 dollars for a ticket of 120 km. How many dollars does Alice pay for each km of the trip?"
PLAIN = "the quick brown fox jumps over the lazy dog while seven wise owls look down from their old oak tree"


def leaks(spark, texts, items, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(docs, bench, **kw).collect()}


def test_words_and_marks(spark):
    text = "In May Alice paid 35 dollars.\nThe trip took 5km, or 3.5 hours, at 7:30; x2y ALL CAPS €4"
    got = spark.createDataFrame([(text,)], "t string").select(D.marked(F.col("t"))).first()[0]
    assert got == "1in 1may 1alice paid 035 2dollars 1the trip took 05 2km or 03.5 2hours at 07:30 x 02 y all caps 04"


def test_copies_and_reparameterised_questions(spark):
    other = ITEM.replace("Alice", "Bertrand").replace("35", "48").replace("120 km", "77 miles").replace("each km", "each mile").replace("9:30", "11:05")
    torn = ITEM.replace("Alice pays 35", "Bertrand pays 35").replace("does Alice", "does Cecile")
    texts = [(1, "Before it. " + ITEM + " And after."), (2, "x\n" + other), (3, torn), (4, "nothing of the kind here"), (5, None), (6, ""), (7, PLAIN.upper()), (None, ITEM), (1, "other text, same id")]
    got = leaks(spark, texts, [(10, ITEM), (11, PLAIN), (12, None), (13, "Too few"), (None, PLAIN)])
    # two names for one in 3: the windows that hold them do not count, and too few are left
    assert set(got) == {(1, 10), (2, 10), (7, 11), (None, 10)}
    assert got[1, 10]["exact"] and got[1, 10]["share"] == 1.0 and not got[2, 10]["exact"] and got[2, 10]["share"] >= 0.8


def test_against_brute_force(spark):
    r = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "e", "i", "ou")]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(words(r.choice([4, 6, 8, 15, 40])))) for k in range(12)]
    texts = []
    for k in range(60):
        w = words(r.choice([0, 5, 60]))
        if k % 3:
            part = items[r.randrange(12)][1].split()
            part = part[: max(1, int(len(part) * r.choice([0.3, 0.6, 1])))]
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        texts.append((k, " ".join(w)))
    want = {}
    for i, t in texts:
        for j, u in items:
            a, b = t.split(), u.split()
            n = min(D.WINDOW, len(b))
            mine = {tuple(a[x : x + n]) for x in range(len(a) - n + 1)}
            starts = range(len(b) - n + 1)
            hit = sum(tuple(b[x : x + n]) in mine for x in starts)
            if hit >= D.SHARE * len(starts):
                want[i, j] = hit
    assert {k: v["matched"] for k, v in leaks(spark, texts, items).items()} == want


def tokens(text):
    """(kind, word) of each word: number, name, unit or None."""
    out = []
    for x in re.findall(r"[0-9]+(?:[.,:/][0-9]+)*|[A-Za-z]+", text):
        number = x[0].isdigit()
        unit = bool(out) and out[-1][0] == "number" and x.lower() in D.UNITS.split("|")
        name = not number and len(x) > 1 and x[0].isupper() and x[1].islower()
        out.append(("number" if number else "name" if name else "unit" if unit else None, x.lower()))
    return out


def slow_leaks(text, item):
    """(matched, exact) of a text that holds an item with template windows, by loops over alignments."""
    d, i = tokens(text), tokens(item)
    n = min(D.WINDOW, len(i))
    typed = lambda w: [(k, None if k else x) for k, x in w]
    starts = [p for p in range(len(i) - n + 1) if sum(k is None for k, _ in i[p : p + n]) >= (D.LITERALS if n == D.WINDOW else D.SHORT_LITERALS)]
    ranks = {p: r for r, p in enumerate(starts)}
    best_typed, best_either, run = [], [], False
    for shift in range(-len(i), len(d)):
        at = [p for p in starts if p + shift >= 0 and p + shift + n <= len(d)]
        alike = [p for p in at if typed(d[p + shift : p + shift + n]) == typed(i[p : p + n])]
        values = defaultdict(set)
        for p in alike:
            for (k, x), (_, y) in zip(i[p : p + n], d[p + shift : p + shift + n]):
                if k:
                    values[k, x].add(y)
        good = {ranks[p] for p in alike if all(len(values[k, x]) == 1 for k, x in i[p : p + n] if k)}
        same = {ranks[p] for p in at if [x for _, x in d[p + shift : p + shift + n]] == [x for _, x in i[p : p + n]]}
        exact = all(v == {x} for (_, x), v in values.items())
        best_typed.append((good, exact))
        best_either.append((good | same, exact))
        run |= any(all(r + k in good | same for k in range(D.RUN)) for r in good | same)
    for found in (best_typed, best_either):
        matched = set().union(*(x for x, _ in found))
        share = len(matched) / len(starts)
        if share >= D.SHARE or (run and found is best_either):
            return len(matched), max((len(x), exact) for x, exact in found)[1]
    return None


def test_slots_against_brute_force(spark):
    r = random.Random(11)
    vocab, names, units = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "nr"], ["Alice", "Bob", "Cecile", "Dora", "Emil"], ["km", "euros", "kg", "hours"]

    def sentence(n):
        out = []
        while len(out) < n:
            x = r.random()
            out += [str(r.randrange(40)), r.choice(units)] if x < 0.1 else [str(r.randrange(9))] if x < 0.2 else [r.choice(names)] if x < 0.35 else [r.choice(vocab)]
        return [out[0].capitalize() if out[0].isalpha() else out[0], *out[1:]]

    def other(words):
        swap = dict(zip(names, r.sample(names, len(names))))
        numbers = {}
        out = [swap.get(w, numbers.setdefault(w, str(r.randrange(90))) if w.isdigit() else r.choice(units) if w in units and r.random() < 0.2 else w) for w in words]
        if r.random() < 0.3:
            out[r.randrange(len(out))] = r.choice(names + vocab + ["7"])
        return out

    items = [(k, " ".join(sentence(r.choice([7, 9, 14, 30, 60])))) for k in range(14)]
    items = [(k, t) for k, t in items if any(sum(x is None for x, _ in tokens(t)[p : p + D.WINDOW]) >= D.LITERALS for p in range(max(1, len(tokens(t)) - D.WINDOW + 1)))]
    texts = []
    for k in range(90):
        w = sentence(r.choice([1, 8, 40]))
        if k % 4:
            part = r.choice(items)[1].split()
            part = part[: max(1, int(len(part) * r.choice([0.4, 0.7, 1])))]
            part = [x.lower() for x in part] if k % 4 == 1 else other(part) if k % 4 == 2 else part
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        texts.append((k, r.choice([" ", " ", "\n"]).join(w) + "."))
    want = {(i, j): x for i, t in texts for j, u in items if (x := slow_leaks(t, u))}
    assert len(want) > 30 and not all(x[1] for x in want.values())
    assert {k: (v["matched"], v["exact"]) for k, v in leaks(spark, texts, items).items()} == want


def test_names_at_the_beginning_of_a_sentence(spark):
    texts = [(1, "solve this, then Alice bought 12 pens for 3 euros"), (2, "Bob bought 15 pens for 9 euros"), (3, "now: what is 2 + 2? or"), (4, "So name the capital."), (5, "Bob sold 15 pens for 9 euros"), (6, "then Eve bought 15 pens for 9 dollars. Well.")]
    got = leaks(spark, texts, [(10, "Alice bought 12 pens for 3 euros"), (11, "What is 2 + 2?"), (12, "Name the capital")])
    assert set(got) == {(1, 10), (2, 10), (3, 11), (4, 12), (6, 10)} and got[1, 10]["exact"] and not got[2, 10]["exact"]


def test_very_long_texts(spark):
    filler = "so it goes on and on " * 60_000
    assert set(leaks(spark, [(1, filler + ITEM), (2, filler), (3, "x" * 2_000_000)], [(10, ITEM)])) == {(1, 10)}


def test_rows_that_leak_go_and_all_else_stays(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (1, "clean", "b"), (2, None, None), (None, ITEM, "c"), (3, "clean", "d"), (3, "clean", "d")], "doc_id long, text string, __row_id string")
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    got = sorted(map(tuple, D.drop_leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, "clean", "b"), (2, None, None), (3, "clean", "d"), (3, "clean", "d")], key=str)
    assert D.drop_leaks(docs, bench.limit(0)).count() == 6 and D.find_leaks(docs.limit(0), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).columns == D.find_leaks(docs, bench).columns


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = D.find_leaks(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_copies_in_other_case_and_wrapping(spark):
    short = "Alice has four red apples in Rome"
    texts = [(1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.replace(" Alice", "\nAlice")), (4, "so he said " + short + " and left"), (5, short.lower()), (6, short.replace("red", "green")), (7, ITEM.lower()[:50])]
    got = leaks(spark, texts, [(10, ITEM), (11, short)])
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 11), (5, 11)}
    assert all(r["exact"] and r["share"] == 1.0 for r in got.values())


def test_items_without_template_windows_are_matched_exactly(spark):
    sums = " ".join(f"{k} plus {k + 1}" for k in range(10, 20))
    texts = [(1, "Q: what is 37 +\n58? A: 95"), (2, "What is 37 + 59?"), (3, "he said Too Few, then left"), (4, "too many or few"), (5, "x " + sums + " y"), (6, sums.replace("19", "91")), (7, sums[:60] + " and " + sums[40:])]
    got = leaks(spark, texts, [(10, "What is 37 + 58?"), (11, "Too few"), (12, sums), (13, "?!"), (14, "")])
    assert set(got) == {(1, 10), (3, 11), (5, 12)}
    assert all(r["exact"] and r["matched"] == r["item_windows"] for r in got.values())


def test_long_passages_of_longer_items(spark):
    r = random.Random(5)
    words = [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.choice('klmn')}{r.choice('aeiou')}" for _ in range(140)]
    words[40], words[60] = "35", "35"
    other = words[30:90]
    other[10], other[30] = "48", "48"
    n = D.RUN + D.WINDOW - 1
    broken = words[70 : 70 + n]
    broken[n // 2] = "otherwise"
    texts = [(1, " ".join(words[30:90])), (2, "x " + " ".join(other)), (3, " ".join(words[70 : 70 + n])), (4, " ".join(words[70 : 69 + n])), (5, " ".join(broken))]
    got = leaks(spark, texts, [(10, " ".join(words))])
    assert {k[0] for k in got} == {1, 2, 3}
    assert got[1, 10]["matched"] == 53 and got[1, 10]["item_windows"] == 133 and got[1, 10]["exact"] and not got[2, 10]["exact"]
