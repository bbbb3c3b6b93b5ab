import random
import string

from quire.llm.decontaminate import MIN_BYTES, MIN_PERCENT, MIN_RUN, WINDOW, clean_documents, found_items
from tests.llm import helpers as H

ITEM = "When Anna walked 12 km to the old market with Peter, Anna bought 5 apples for Peter. How many apples did she carry home?"
PAD = "Some other words stand here before it all begins. " * 3


def found(spark, docs, items=((1, ITEM),)):
    rows = found_items(H.documents(spark, docs), spark.createDataFrame(list(items), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_verbatim_recased_reparameterised_and_inconsistent(spark):
    swapped = ITEM.replace("Anna", "Maria").replace("Peter", "Jonas").replace("12 km", "3.5 miles").replace("5 apples", "17 apples")
    docs = [
        (10, PAD + ITEM + " " + PAD), (11, PAD + ITEM.upper()), (12, ITEM.lower().replace(",", "").replace(" ", "\n\t")),
        (13, PAD + swapped), (14, PAD), (15, None), (16, ""), (None, ITEM),
        (17, "When Peter walked 12 km to the old town with a dog they were tired and slept"),
    ]
    got = found(spark, docs)
    assert {d for d, _ in got} >= {10, 11, 12, 13} and not {d for d, _ in got} & {14, 15, 16, 17, None}
    assert got[13, 1].reparameterised and not got[10, 1].reparameterised
    assert got[10, 1].covered == got[10, 1].item_words == len(ITEM.split()) and got[10, 1].first_word == len(PAD.split())


def test_slots_must_be_consistent(spark):
    item = "then Anna saw Anna and Anna met Anna while Anna ran"
    good, bad = "then Olga saw Olga and Olga met Olga while Olga ran", "then Olga saw Maria and Ida met Eva while Lea ran"
    got = found(spark, [(1, "Now " + good), (2, "Now " + bad)], [(7, item)])
    assert set(got) == {(1, 7)}


def test_short_repeated_and_null_items(spark):
    items = [(1, "blue whales sing loudly"), (2, "a b"), (3, None), (None, ITEM), (5, ITEM), (6, ITEM), (6, ITEM)]
    docs = [(1, "we know that Blue whales sing loudly, at night"), (2, "a b " * 20), (3, ITEM), (3, ITEM), (4, "x " * 50_000 + ITEM)]
    assert set(found(spark, docs, items)) == {(1, 1), (3, 5), (3, 6), (4, 5), (4, 6)}
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_sent_and_joined_windows_agree(spark):
    docs = [(i, PAD + (ITEM if i % 3 else "nothing of it")) for i in range(9)]
    a = found(spark, docs)
    d, i = H.documents(spark, docs), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    b = {(r.doc_id, r.item_id): r for r in found_items(d, i, sent=0).collect()}
    assert a == b and len(a) == 6
    left = clean_documents(d, i)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [0, 3, 6]


def test_verbatim_copies_of_sums_short_items_and_unspaced_scripts(spark):
    series = " ".join(str(7 * i % 61) for i in range(40))
    table = "Year 2001 2002 2003 2004 2005 2006 2007 2008 Sales 11 12 13 14 15 16 17 18"
    items = [(1, "Compute 12 + 34 * 56 - 78"), (2, "Define osmosis briefly"), (3, series), (4, table), (5, "東京の人口は何人ですか"), (6, "Photosynthesis?"), (7, "国")]
    docs = [
        (1, PAD + "Compute 12 + 34 * 56 - 78 " + PAD), (2, PAD + "define osmosis, briefly! " + PAD), (3, PAD + series), (4, PAD + table + " " + PAD),
        (5, "次の質問:東京の人口は何人ですか?答えは"), (6, "what is photosynthesis"), (8, "Compute 12 + 34 * 56 - 79"), (9, "define osmosis very briefly"), (10, "東京の面積は"), (11, None),
        (12, "中国 "),
    ]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (12, 7)}
    assert got[5, 5].covered == got[5, 5].item_words == 11 and got[5, 5].first_word == 4
    assert got[3, 3].covered == 40 and not got[3, 3].reparameterised


def test_changed_word_counts_split_an_item_over_diagonals(spark):
    plain = "one may ask why rivers bend so often while canals stay straight over long flat plains where nothing stops them from turning at all"
    w = plain.split()
    more, less = [*w[:8], "perhaps", *w[8:16], "really", *w[16:]], "zero " * 60
    named = "one may ask why rivers bend so for Anna Berg while canals stay straight by Peter Holm flat plains where nothing stops them today"
    short = named.replace("Anna Berg", "Olga").replace("Peter Holm", "Ida")
    long = named.replace("Anna Berg", "Olga Maria Klein").replace("Peter Holm", "Ida")
    mixed = "Mix 3 1/2 cups of flour with warm milk then add 2 1/4 spoons of butter and bake"
    items = [(1, plain), (2, named), (3, mixed)]
    docs = [
        (1, PAD + " ".join(more)), (2, PAD + short), (3, PAD + long + " " + PAD), (4, PAD + mixed.replace("3 1/2", "4").replace("2 1/4", "6")),
        (5, " ".join([*w[:8], *less.split(), *w[16:]])), (6, PAD + plain + " " + plain),
    ]
    got = found(spark, docs, items)
    assert set(got) >= {(1, 1), (2, 2), (3, 2), (4, 3), (6, 1)} and (5, 1) not in got
    assert got[1, 1].covered == 24 and got[1, 1].first_word == len(PAD.split()) and not got[1, 1].reparameterised
    assert got[2, 2].covered == 24 and got[2, 2].reparameterised and got[4, 3].reparameterised
    assert got[6, 1].covered == 24 and got[6, 1].first_word == len(PAD.split())
    # a slot's value must stay the same on all diagonals: 'Anna Berg' became two names
    twice = "when Anna Berg walks over the old stone bridge then people greet Anna Berg with songs from the small town"
    same, differ = twice.replace("Anna Berg", "Olga"), twice.replace("Anna Berg", "Olga", 1).replace("Anna Berg", "Ida")
    got = found(spark, [(1, PAD + same), (2, PAD + differ)], [(9, twice)])
    assert got[1, 9].covered == got[1, 9].item_words and got[2, 9].covered < got[2, 9].item_words


def test_copies_of_an_item_are_not_broadcast(spark):
    d, i = H.documents(spark, [(1, PAD + ITEM)]), spark.createDataFrame([(k, ITEM) for k in range(30)], "item_id long, text string")
    for sent, hinted in ((200, False), (1_000_000, True)):
        out = found_items(d, i, sent=sent)
        assert ("strategy=broadcast" in out._jdf.queryExecution().logical().toString()) == hinted
        assert out.count() == 30


def test_tiny_items_fill_whole_lines(spark):
    items = [(1, "a b"), (2, "x"), (3, "p\nq"), (4, "é"), (5, "?!")]
    docs = [
        (1, "a b"), (2, "see\n- a b.\nend"), (3, "a b c"), (4, "c a b"), (5, "a\nb"), (6, "X"), (7, "x x"), (8, "one\r\n x \r\ntwo"),
        (9, "p\nq"), (10, "p q"), (11, "o p\nq"), (12, "É\né"), (13, "?!"), (14, ""), (15, "no\n\n\np\n\nq\nyes"),
    ]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 1), (5, 1), (6, 2), (8, 2), (9, 3), (10, 3), (15, 3), (12, 4)}


def plain_words(text):
    """Lower-case words without punctuation at their ends, and the line of each."""
    out = []
    for k, line in enumerate(text.split("\n")):
        out += [(x, k) for x in (w.strip(string.punctuation).lower() for w in line.split()) if x]
    return [x for x, _ in out], [k for _, k in out]


def brute_found(doc, item):
    """Whether an item without numbers and names is in a document, and the words covered."""
    d, lines = plain_words(doc)
    i, _ = plain_words(item)
    size = min(len(i), WINDOW)
    if not size:
        return None
    tiny = sum(len(x.encode()) for x in i) < MIN_BYTES
    covered = {}
    for a in range(len(d) - size + 1):
        whole = (a == 0 or lines[a - 1] != lines[a]) and (a + size == len(d) or lines[a + size - 1] != lines[a + size])
        for b in range(len(i) - size + 1):
            if d[a : a + size] == i[b : b + size] and (whole or not tiny):
                covered.setdefault(a - b, set()).update(range(b, b + size))
    width, best = max(len(i), WINDOW), 0
    for band in {s // width for s in covered} | {s // width - 1 for s in covered}:
        best = max(best, len(set().union(*[c for s, c in covered.items() if s // width in (band, band + 1)])))
    return best if best and (100 * best >= MIN_PERCENT * len(i) or best >= MIN_RUN) else None


def test_found_items_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = ["a", "b", "c.", "(d)", "ee", "f-g", "hh,", "\n", "iii", "jj\n", "-", "é", "to", "of", "x"]
    text = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(0, 5), vocab)) for k in range(40)]
    items += [(100 + k, text(rng.randint(6, 40), vocab)) for k in range(40)]
    docs = [(k, text(rng.randint(0, 60), vocab)) for k in range(60)]
    for k in range(60):  # parts of items, some cut or with a word put in
        w = rng.choice(items[40:])[1].split(" ")
        a, b = sorted(rng.randint(0, len(w)) for _ in range(2))
        part = w[a:b] if k % 3 else w
        part = [*part[: len(part) // 2], rng.choice(vocab), *part[len(part) // 2 :]] if k % 2 else part
        docs.append((200 + k, " ".join([text(rng.randint(0, 20), vocab), *part, text(rng.randint(0, 9), vocab)])))
    got = {k: r.covered for k, r in found(spark, docs, items).items()}
    want = {(d, i): n for d, t in docs for i, x in items if (n := brute_found(t, x)) is not None}
    assert got == want and len(want) > 300
