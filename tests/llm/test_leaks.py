import random

import numpy as np
from pyspark.sql import functions as F

from fieldlead.llm import leaks
from fieldlead.llm.words import words

ITEM = "Explain in your own words why a rigid gate electrode from Steinbrügge could not count toward the finest field of two-port memory banks in 1997"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, item_text string")


def longest(a, b):
    best = 0
    table = [0] * (len(b) + 1)
    for x in a:
        table = [0] + [table[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(table))
    return best


def greedy(a, b, least):
    """Greedy string tiling by the book: the longest match of unmarked words again and again."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sorted(out)
        n, i, j = best
        used_a[i : i + n] = [True] * n
        used_b[j : j + n] = [True] * n
        out.append(n)


def test_spellings_of_the_same_words(spark):
    variants = [
        ITEM.upper(), ITEM.replace(" ", "\u00a0"), ITEM.replace("electrode", "elec\u00adtrode"), ITEM.replace("electrode", "elec-\ntrode"), ITEM.replace("electrode", "elec-\n> trode"),
        ITEM.replace("electrode", "elec\u00ad\n  trode"), ITEM.replace("electrode", "elec\u2010 \r\ntrode"), ITEM.replace("fi", "\ufb01"), ITEM.replace("\u00fc", "u\u0308"), ITEM.replace(" ", "\n* "),
        ITEM.replace(" ", ", "), ITEM.replace("two-port", "two-\nport"), ITEM.replace("two-port", "two\u2011port"), ITEM.replace("gate", "ga\u200bte"), "\uff21 b " + ITEM,
    ]
    out = leaks.shared_passages(docs_of(spark, variants), items_of(spark, [ITEM])).collect()
    size = len(words(ITEM))
    assert {r["doc_id"]: r["longest_tile"] for r in out} == {i: size for i in range(len(variants))}


def test_boundary_of_twelve_words(spark):
    w = words(ITEM)
    texts = [" ".join(w[3:15]), " ".join(w[3:14]), "x " + " ".join(w[:12]) + " y", " ".join(w[:11] + ["zzz"] + w[12:23]), None, "", "   ", " ".join(w)]
    out = leaks.leaks(leaks.shared_passages(docs_of(spark, texts), items_of(spark, [ITEM, "too short", None, ""])), min_coverage=2.0).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(0, 0), (2, 0), (7, 0)]


def test_reordered_passages_add_up(spark):
    w = words(ITEM)
    text = " ".join(w[16:] + ["q"] + w[8:16] + ["q"] + w[:8])
    (r,) = leaks.shared_passages(docs_of(spark, [text]), items_of(spark, [ITEM]), min_tile=6).collect()
    assert (r["tiles"], r["covered_words"], r["item_words"]) == (3, len(w), len(w)) and r["longest_tile"] < 12
    assert leaks.leaks(spark.createDataFrame([r])).count() == 1


def test_against_brute_force(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [" ".join(random.choices(vocabulary, k=random.randrange(3, 40))) for _ in range(12)]
    texts = [" ".join(random.choices(vocabulary, k=random.randrange(0, 60))) for _ in range(15)]
    texts += [" ".join(["zz"] * 3 + items[i].split()[:9] + ["unknown"] + items[i + 1].split()[-9:]) for i in range(6)]
    for least in (3, 5):
        got = {(r["doc_id"], r["item_id"]): (r["longest_tile"], r["covered_words"], r["tiles"]) for r in leaks.shared_passages(docs_of(spark, texts), items_of(spark, items), min_tile=least).collect()}
        want = {(d, i): longest(t.split(), s.split()) for d, t in enumerate(texts) for i, s in enumerate(items)}
        assert {k: v[0] for k, v in got.items()} == {k: n for k, n in want.items() if n >= least}
        for (d, i), (first, covered, tiles) in got.items():
            book = greedy(texts[d].split(), items[i].split(), least)
            assert book[-1] == first and covered <= len(items[i].split()) and tiles >= 1


def test_tiles_never_overlap():
    random.seed(11)
    for _ in range(60):
        a, b = (np.array([random.randrange(1, 4) for _ in range(random.randrange(5, 40))]) for _ in range(2))
        seeds = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if (a[i : i + 3] == b[j : j + 3]).all()]
        if not seeds:
            continue
        found = leaks.tiles(a, b, np.array([s[0] for s in seeds]), np.array([s[1] for s in seeds]), 3)
        for axis in (0, 1):
            spots = [x for t in found for x in range(t[axis], t[axis] + t[2])]
            assert len(spots) == len(set(spots))
        assert all((a[i : i + n] == b[j : j + n]).all() and n >= 3 for i, j, n in found)


def test_blocks_repeats_and_empty(spark):
    w = words(ITEM)
    items = [ITEM, ITEM, " ".join(reversed(w)), "another item that nobody has ever copied into any text of this corpus at all"]
    texts = [ITEM, ITEM, " ".join(reversed(w)), "x " * 50_000 + "y" * 400_000 + "\n" + ITEM]
    whole = leaks.shared_passages(docs_of(spark, texts), items_of(spark, items)).select("doc_id", "item_id", "longest_tile")
    parts = leaks.shared_passages(docs_of(spark, texts), items_of(spark, items), block_words=30).select("doc_id", "item_id", "longest_tile")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert {(r[0], r[1]) for r in whole.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 0), (3, 1)}
    empty_items, empty_docs = items_of(spark, ["a"]).where("false"), docs_of(spark, ["a"]).where("false")
    assert leaks.shared_passages(docs_of(spark, texts), empty_items).count() == 0
    assert leaks.shared_passages(empty_docs, items_of(spark, items)).count() == 0
    twice = items_of(spark, items)
    assert leaks.shared_passages(docs_of(spark, texts), twice.unionByName(twice)).count() == 7
    extra = docs_of(spark, texts).withColumns({"d": F.lit(1), "t": F.lit("t"), "item_id": F.lit(9)})
    assert leaks.shared_passages(extra, items_of(spark, items)).count() == 7


def test_hyphens_at_line_ends_do_not_depend_on_other_items(spark):
    """Both readings of a broken word are open, on either side and over several lines, whatever else stands in the item table."""
    rest = "the gate of a quiet memory bank could not count toward any of the finest fields"
    items = [f"a well known {rest}", f"a won-\nderful {rest}", f"a wonderful {rest}", f"wellknown {rest} again", f"an in-\nter-\nnational {rest}"]
    texts = [
        f"a well-\nknown {rest}", f"a won-\nderful {rest}", f"a won-\nder-\nful {rest}", f"a wonderful {rest}", f"a won-\n> derful {rest}", f"wellknown {rest} again",
        f"an international {rest}", f"an inter-\nnational {rest}", f"well-\nknown {rest} again",
    ]
    n = len(words(rest))
    for block_words in (500_000, 30, 1):
        got = {(r["doc_id"], r["item_id"]): r["longest_tile"] for r in leaks.shared_passages(docs_of(spark, texts), items_of(spark, items), block_words=block_words).collect()}
        assert len(got) == 45  # all share the rest
        assert got[0, 0] == n + 3
        assert got[1, 1] == n + 3 and got[2, 1] == n + 3 and got[3, 1] == got[4, 1] - 1 == n + 2
        assert got[1, 2] == got[2, 2] == got[3, 2] == got[4, 2] == n + 2
        assert got[5, 3] == got[8, 3] == n + 2 and got[8, 0] == n + 2
        assert got[6, 4] == n + 2 and got[7, 4] == n + 3


def test_pieces_at_line_ends_against_all_readings(spark):
    """Texts and items broken at random: the longest run equals that of the best pair of readings."""
    import itertools

    random.seed(21)

    def broken(w):
        return "".join(c + ("-\n" if k < len(w) - 1 and random.random() < 0.3 else "") for k, c in enumerate(w))

    def readings(text):
        pieces = text.split("-\n")
        for glue in itertools.product(("", " "), repeat=len(pieces) - 1):
            yield "".join(x + y for x, y in zip(pieces, (*glue, ""))).split()

    vocabulary = ["ab", "abc", "c", "a", "bc"]
    texts = [" ".join(broken(w) if random.random() < 0.5 else w for w in random.choices(vocabulary, k=7)) for _ in range(25)]
    items = [" ".join(broken(w) if random.random() < 0.3 else w for w in random.choices(vocabulary, k=6)) for _ in range(15)]
    got = {(r["doc_id"], r["item_id"]): r["longest_tile"] for r in leaks.shared_passages(docs_of(spark, texts), items_of(spark, items), min_tile=3).collect()}
    for d, t in enumerate(texts):
        for i, s in enumerate(items):
            best = max(longest(x, y) for x in readings(t) for y in readings(s))
            assert got.get((d, i), 0) == (best if best >= 3 else 0), (t, s)


def test_recall_on_planted_reorderings(spark):
    """Items cut into pieces of six to eleven words, shuffled, half of them left out at most: nine of ten are reported, and nothing else."""
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(random.choices(vocabulary, k=random.randrange(40, 90))) for _ in range(60)]
    texts, planted = [], set()
    for d in range(240):
        text = random.choices(vocabulary, k=60)
        if d % 2:
            i = random.randrange(len(items))
            w, pieces = items[i].split(), []
            while len(w) >= 6:
                n = random.randrange(6, 12)
                pieces.append(w[:n])
                w = w[n:]
            kept = random.sample(pieces, max(1, round(0.75 * len(pieces))))
            for p in kept:
                text[random.randrange(len(text)) : 0] = [*p, "filler"]
            if sum(map(len, kept)) >= 0.5 * len(items[i].split()):
                planted.add((d, i))
        texts.append(" ".join(text))
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(leaks.shared_passages(docs_of(spark, texts), items_of(spark, items), min_tile=6)).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 0.05 * len(found)
