"""Line dedup, quality rules, n-gram join, decontamination, language ID against brute force, and their edge cases."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, langid, linededup, ngramjoin, quality, queries
from chatloom.llm.common import table
from chatloom.llm.components import components

EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "alone here with five words"), (None, None), (4, "x"), (4, "x"), (5, "word " * 20_000), (6, "one two three four five\n\none two three four five"), (7, "ONE two three four five"), (8, "a\x0bb\x0cc\u00a0d e")]


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- line dedup -----------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def judged_by_hand(rows, least=10):
    """(doc, line_no) of every line with a word: repeat, near (to one that stays), words, and the place of the line that
    stands for it."""
    seen, out = {}, {}  # words: first place, in order
    for doc, text in sorted(((d, t) for d, t in rows if t), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(text.split("\n")):
            w = tuple(split(line.lower()))
            if w:
                like = next((seen[x] for x in seen if min(len(w), len(x)) >= least and x != w and out[seen[x]][4] is None and one_edit(x, w)), None) if w not in seen else out[seen[w]][4]
                out[doc, k] = [w in seen, like is not None, w, like or (seen[w] if w in seen else None), like]
                seen.setdefault(w, (doc, k))
    return {p: tuple(x[:4]) for p, x in out.items()}


def test_line_dedup_by_brute_force(spark, docs):
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(8, 15))] for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(0, 2)] = rng.choice([[], ["z"], [rng.choice("abcdefgh")]])
            w = w or ["q"]
        return rng.choice([" ", "  ", "\t"]).join(w).replace("a", rng.choice("aA"))

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(120)]
    got = {(r.doc, r.line_no): (r.repeat, r.near, None if r.kept_line is None else (r.kept_doc, r.kept_line)) for r in linededup.judged_lines(docs(rows)).collect()}
    want = {p: (repeat, near, stands) for p, (repeat, near, _, stands) in judged_by_hand(rows).items()}
    assert got == want and sum(n for _, n, _ in want.values()) > 20
    told = {r.doc_id: r for r in linededup.report(docs(rows)).collect()}
    for d, text in rows:
        lines = {k: x for (doc, k), x in judged_by_hand(rows).items() if doc == d}
        gone = {k: x for k, x in lines.items() if x[0] or x[1]}
        r = told[d]
        assert (r.n_lines, r.n_repeats, r.n_near) == (len(lines), sum(x[0] for x in gone.values()), sum(not x[0] for x in gone.values()))
        assert [(x.line_no, (x.doc, x.line)) for x in r.links or []] == [(k, x[3]) for k, x in gone.items()]
        assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) and r.kept == (not gone or bool(split(r.text)))


def test_no_line_goes_for_a_line_that_goes(spark, docs):
    # each line is one word away from the one before, the last shares no word with the first: every other one stays
    words = [f"w{i}" for i in range(10)]
    rows = [(i + 1, " ".join([f"x{k}" for k in range(i)] + words[i:])) for i in range(11)]
    rows += [(20 + i, text) for i, (_, text) in enumerate(rows[::-1])]  # repeats, whose first lines may be gone
    got = {r.doc: r for r in linededup.judged_lines(docs(rows)).collect()}
    assert [d for d in range(1, 12) if got[d].kept_doc is None] == [1, 3, 5, 7, 9, 11]
    assert {d: got[d].kept_doc for d in range(2, 11, 2)} == {d: d - 1 for d in range(2, 11, 2)}
    assert all(got[r.kept_doc].kept_doc is None for r in got.values() if r.kept_doc is not None)
    assert {r.doc_id for r in linededup.dedup_lines(docs(rows)).collect()} == {1, 3, 5, 7, 9, 11}
    want = judged_by_hand(rows)
    assert {(r.doc, r.line_no): (r.repeat, r.near, None if r.kept_line is None else (r.kept_doc, r.kept_line)) for r in got.values()} == {p: (a, b, c) for p, (a, b, _, c) in want.items()}


def test_many_lines_of_one_pattern(spark, docs):
    # all of one key: one round, no pairs, the earliest stays
    rows = [(i, f"page {i} of the report on trade in the northern lands and isles") for i in range(3000)]
    left = linededup.dedup_lines(docs(rows)).collect()
    assert [r.doc_id for r in left] == [0]


def test_line_dedup_edges(spark, docs):
    got = sorted(((r.doc_id, r.n_lines, r.n_repeats, r.n_near, r.kept) for r in linededup.report(docs(EDGES)).collect()), key=repr)
    # a line of 20,000 words is one line; the null doc_id comes first, so its line vouches for none here
    want = [(1, 0, 0, 0, True), (2, 0, 0, 0, True), (3, 0, 0, 0, True), (None, 1, 0, 0, True), (None, 0, 0, 0, True), (4, 1, 0, 0, True), (4, 1, 0, 0, True), (5, 1, 0, 0, True), (6, 2, 1, 0, True), (7, 1, 1, 0, False), (8, 1, 0, 0, True)]
    assert got == sorted(want, key=repr)
    kept = {(r.doc_id, r.text) for r in linededup.dedup_lines(docs(EDGES)).collect()}
    assert (6, "one two three four five\n") in kept and 7 not in {d for d, _ in kept} and (1, None) in kept and (3, " \n\t ") in kept
    assert linededup.report(docs(EDGES).limit(0)).count() == 0
    assert linededup.dedup_lines(docs(EDGES)).columns == docs(EDGES).columns
    clash = docs(EDGES).selectExpr("*", "1 as row", "2 as r", "3 as links", "4 as rest", "'5' as _row", "6 as kept")
    found = linededup.dedup_lines(clash)
    assert found.columns == clash.columns and {tuple(r)[-6:] for r in found.collect()} == {(1, 2, 3, 4, "5", 6)}


# --- quality --------------------------------------------------------------------------------------------------------


def base_by_hand(text):
    text = text or ""
    w = split(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    held = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def test_quality_counts_by_brute_force(spark, docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["ab ", "cd ", "e\n", "# ", "<f> ", "\t"]) for _ in range(rng.randrange(0, 80)))) for i in range(80)] + [(100 + i, t) for i, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs(rows)).collect()}
    assert got == {d: base_by_hand(t) for d, t in rows}


def test_frequent_lines_are_counted_by_text(spark, docs):
    common = "this line is in each document of the host and it is long enough to matter"
    rows = [(i, f"{common}\nown words {i} " + " ".join(f"w{i}x{k}" for k in range(25 if i % 2 else 3)), "en", "h") for i in range(30)]
    rows += [(100 + i, "the same text in a hundred copies " + " ".join(f"c{k}" for k in range(30)), "en", "h") for i in range(100)]
    got = {r.doc_id: r for r in quality.judge(docs(rows)).collect()}
    assert all(got[i].n_line_words == 16 and got[i].kept == bool(i % 2) for i in range(30))
    assert all(got[100 + i].kept for i in range(100))  # copies count once
    rest = quality.remove_frequent_lines(docs(rows)).where("doc_id = 1").first().text
    assert rest.startswith("own words 1 ")
    assert quality.judge(docs(rows).limit(0)).count() == 0


# --- n-gram join ----------------------------------------------------------------------------------------------------


def components_by_hand(rows):
    sets = []
    for _, text in rows:
        w = split("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, len(s), (min(least[find(i)]) if least[find(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(seed, n, size, rate):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(9999)}" for _ in range(size)]
    return [" ".join(f"n{rng.randrange(9999)}" if rng.random() < rate * rng.random() else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 8])
def test_ngram_components_by_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rng = random.Random(3)
    shared = " ".join(f"p{k}" for k in range(60))
    texts = near_copies(1, 40, 60, 0.12) + near_copies(2, 40, 120, 0.1) + near_copies(4, 10, 6, 0.3) + [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += [shared + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(texts[::5])), *((d if d is None else 2000 + d, t) for d, t in EDGES)]
    got = sorted((tuple(r) for r in ngramjoin.jaccard_components(docs(rows)).collect()), key=repr)
    assert got == components_by_hand(rows)


def test_ngram_join_of_an_empty_table(spark, docs):
    assert ngramjoin.jaccard_components(docs(EDGES).limit(0)).count() == 0
    assert ngramjoin.jaccard_components(docs([(1, None)])).first().component_id == 1


def test_ngram_query_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op5_ngram_join(spark, sf_dir).collect()), key=repr) == components_by_hand(rows)


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------


def bags(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def leaks_by_hand(rows, items):
    out = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, b in items:
            v = b.lower().split()
            for s in range(max(len(w) - len(v), 0) + 1) if w and v else []:
                x, y = bags(w[s : s + len(v)]), bags(v)
                n = sum((x & y).values())
                score = n / (sum(x.values()) + sum(y.values()) - n)
                if score >= 0.75 and score > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (s, score)
    return out


def test_decontamination_by_brute_force(spark, docs):
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.choice([5, 12, 30, 30])))) for i in range(25)]
    rows = []
    for d in range(150):
        w = [f"v{rng.randrange(40)}" for _ in range(rng.randrange(0, 50))]
        if d % 2:
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["new"], [copy[k], "in"]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
        rows.append((d, " ".join(w).upper() if d % 3 else " ".join(w)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(docs(rows), benchmark).collect()}
    want = leaks_by_hand(rows, items)
    assert len(want) > 30 and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    # of windows of one score any that begins with a shared shingle may be named
    texts, names = dict(rows), dict(items)
    for (d, i), (start, score) in got.items():
        v = names[i].split()
        window = " ".join(texts[d].split()[start : start + len(v)])
        assert leaks_by_hand([(d, window)], [(i, names[i])])[d, i][1] == score


def test_decontamination_edges(spark, docs):
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "word " * 12), (None, "alone here with five words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs([*EDGES, (9, "zero, " + item.upper() + "! eleven")]), benchmark).collect()}
    assert got == {(9, 1), (5, 4), (None, None)}
    assert decontaminate.contaminated(docs(EDGES).limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs(EDGES), benchmark.limit(0)).count() == 0


def test_short_items_are_found_inside_longer_texts(spark, docs):
    items = [(1, "alpha beta gamma"), (2, "delta"), (3, "x y z w"), (4, "one two three four five")]
    rows = [(1, "x y Alpha, beta gamma z"), (2, "alpha beta"), (3, "delta delta!"), (4, "x y z"), (5, "q x y z w x y z w"), (6, "zero one two three four five six"), (7, None), (8, "alpha beta gamma")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(docs(rows), benchmark).collect()}
    assert got == {(1, 1): (2, 1.0), (3, 2): (0, 1.0), (5, 3): (1, 1.0), (6, 4): (1, 1.0), (8, 1): (0, 1.0)}


def test_texts_of_one_key_are_separate(spark, docs):
    item = " ".join(f"v{i}" for i in range(20))
    rows = [(1, f"a {item}"), (1, f"b c {item}"), (1, f"b c {item}"), (None, item), (None, f"z {item}"), (1, "clean text of six words here")]
    got = decontaminate.contaminated(docs(rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 2)]


def prints_by_hand(shingles):
    out = 0
    for b in range(64):
        out |= (2 * sum((h >> b) & 1 for h in shingles) > len(shingles)) << b
    return out


def test_simhash_by_hand(spark, monkeypatch):
    rng = random.Random(8)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 7, 64, 65, 500, 501)]
    df = spark.createDataFrame(rows, "s array<long>")
    want = [prints_by_hand(s) for (s,) in rows]
    for most in (decontaminate.MOST, 3):
        monkeypatch.setattr(decontaminate, "MOST", most)
        got = df.select(decontaminate.simhash(F.col("s")).alias("p")).collect()
        assert [r.p & ((1 << 64) - 1) for r in got] == want


def test_recall_of_the_radius_on_planted_windows(spark, docs):
    """Items with edits that leave a window at 0.75 or more: nearly all are within the radius and so found."""
    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(rng.choice([14, 30, 60, 120])))) for i in range(300)]
    rows, sought = [], set()
    for d in range(3000):
        i, words = d % 300, items[d % 300][1].split()
        for _ in range(rng.randrange(0, 1 + max(1, len(words) // 30))):
            k = rng.choice([rng.randrange(len(words)), len(words) - 1, 0])
            words[k : k + 1] = rng.choice([[], [f"n{d}"], [words[k], f"n{d}"]])
        rows.append((d, " ".join([f"a{d}x{k}" for k in range(8)] + words + [f"b{d}x{k}" for k in range(8)])))
        v, w = items[i][1].split(), rows[-1][1].split()
        best = max(sum((bags(w[s : s + len(v)]) & bags(v)).values()) for s in range(len(w) - len(v) + 1))
        if best / (2 * (len(v) - 4) - best) >= 0.75:
            sought.add((d, i))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), benchmark).collect()}
    assert len(sought) > 1500 and got <= sought and len(got) >= 0.999 * len(sought)


# --- language ID ----------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op7_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 30 and sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.95 * len(out)


def grams_by_hand(text):
    """Buckets of all n-grams of 1 to 3 characters, with whole numbers."""
    codes, out, top = [ord(c) for c in text.lower()], [], (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            key = 0
            for j in range(n):
                key = (key * 0x9E3779B97F4A7C15 + codes[i + j] + j + 1) & top
            out.append((((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9) & top) >> 49)
    return out


def by_bayes(labelled, text, smoothing=0.5):
    """Language and probability of a text, from labelled texts, counted by hand."""
    langs = sorted({lang for _, lang in labelled})
    total = {}
    for lang in langs:
        counts = Counter(g for t, l in labelled if l == lang for g in grams_by_hand(t or ""))
        n = sum(counts.values()) + smoothing * (1 << 15)
        total[lang] = math.log(sum(l == lang for _, l in labelled) / len(labelled)) + sum(math.log((counts[g] + smoothing) / n) for g in grams_by_hand(text))
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)


@pytest.mark.parametrize("block", [langid.BLOCK, 28])
def test_scores_are_those_of_naive_bayes(spark, docs, monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = random.Random(10)
    labelled = [("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 30]))), lang) for lang, letters in (("x", "aabé "), ("y", "abcc "), ("z", "zab\u0130 ")) for _ in range(12)] + [(None, "y")]
    model = langid.train(docs([(i, t, lang, "s") for i, (t, lang) in enumerate(labelled)] + [(99, "zz", None, "s")]))
    assert model.langs == ("x", "y", "z")
    texts = ["abab", "cc b", "é" * 3, "a", "Z" * 40, "ab c" * 30, "\u03a3\u03a3 \u0130"] + ["".join(rng.choice("abcéz ") for _ in range(rng.randrange(1, 60))) + "a" for _ in range(40)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(list(enumerate(texts))), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        lang, score = by_bayes(labelled, text)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-4


def test_too_many_languages_are_an_error(spark, docs):
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs([(i, "a", f"l{i}", "s") for i in range(5)]), most_langs=4)


def test_language_edges(spark, docs):
    model = langid.train(docs([(1, "hello there", "en", "s"), (2, "guten tag", "de", "s")]))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(docs([*EDGES, (20, "12 34 !"), (21, "guten tag")]), model, ["doc_id", "n", "key"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (20, "und"), (21, "de")} <= got
    nothing = langid.train(docs(EDGES).limit(0))
    assert nothing.langs == () and {r.lang_pred for r in langid.predict(docs(EDGES), nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs(EDGES).limit(0), model, ["doc_id"]).count() == 0
