from causeway.llm import decontaminate as D
from causeway.llm.queries import op3_decontamination

from .conftest import SF

ITEM = "If the old farmer sells 12 baskets of fresh plums for 30 dollars each to his friend Anna, how many plums did Anna buy after 5 days?"


def leaks(spark, texts, items=((1, ITEM),), **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.find_leaks(docs, bench, **options).collect()}


def test_copies_and_reparameterised_items_are_found(spark):
    texts = [
        f"Some words before. {ITEM} And some after it.",
        ITEM.upper().replace("?", " ?"),
        ITEM.replace("12", "480").replace("30 dollars", "7 euros").replace("Anna", "Miguel"),
        ITEM.replace("Anna, how", "Bob, how"),                                    # one name became two: the rest is literal and counts
        "A text of its own that shares the old farmer and baskets of fresh plums with no item at all, whatever the day.",
    ]
    found = leaks(spark, texts)
    # a copy in capitals and one with a single altered name are leaks: literal windows are judged by themselves
    assert set(found) == {(0, 1), (1, 1), (2, 1), (3, 1)}
    assert found[0, 1].changed == 0 and found[0, 1].share > 0.9
    assert found[2, 1].changed == 3 or found[2, 1].changed == 4


def test_joined_path_without_broadcast_gives_the_same(spark):
    texts = [f"x {ITEM} y", ITEM.replace("12", "99"), "nothing here at all", None, ""]
    assert set(leaks(spark, texts)) == set(leaks(spark, texts, broadcast_up_to=0)) == {(0, 1), (1, 1)}


def test_short_and_empty_items(spark):
    items = [(1, "green apples taste better"), (2, ""), (3, None), (4, "7 8 9"), (None, "quiet rivers run deep today")]
    found = leaks(spark, ["we say green apples taste better now", "1 2 3 7 8 9", "", None, "quiet rivers run deep today"], items)
    assert set(found) == {(0, 1), (1, 4), (4, None)}  # an item of numbers is found like any other


def test_a_word_or_two_are_no_item(spark):
    texts = [f"the sky over town {i} and the hill" for i in range(50)]
    assert leaks(spark, texts, [(1, "the"), (2, "The sky"), (3, "the sky over")]).keys() == {(i, 3) for i in range(50)}
    assert len(leaks(spark, texts, [(1, "the"), (2, "The sky")], least_item=1)) == 100


def brute_leaks(texts, items, width=8, least_tokens=13, least_share=0.5):
    """Literal leaks by plain search: tokens of an item covered by equal windows along one alignment."""
    out = set()
    for i, t in enumerate(texts):
        d = [w for w in ("".join(c for c in w if c.isalnum()) for w in (t or "").lower().split()) if w]
        for k, item in items:
            b = [w for w in ("".join(c for c in w if c.isalnum()) for w in item.lower().split()) if w]
            wide = min(width, len(b))
            for line in range(-len(b), len(d)):
                hit = {p + j for p in range(len(b) - wide + 1) if 0 <= p + line and p + line + wide <= len(d) and b[p:p + wide] == d[p + line:p + line + wide] for j in range(wide)}
                if len(hit) >= least_tokens or len(hit) >= least_share * len(b):
                    out.add((i, k))
    return out


def test_equals_brute_force_on_plain_words(spark):
    import random
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmno")
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 40)))) for k in range(12)]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(rng.randint(0, 30))]
        source = rng.choice(items)[1].split()
        a = rng.randrange(len(source))
        at = rng.randint(0, len(w))
        w[at:at] = source[a:a + rng.randint(1, 30)]
        texts.append(" ".join(w))
    want = brute_leaks(texts, items)
    assert want and set(leaks(spark, texts, items)) == want == set(leaks(spark, texts, items, broadcast_up_to=0))


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the moon over the quiet hill", "extra")], "item_id long, text string, row string")
    hit = sorted({r.doc_id for r in D.find_leaks(edge_docs, bench).collect()}, key=str)
    assert hit == [4, 5, None]
    clean = D.decontaminate(clashing, bench)
    assert clean.columns == clashing.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 6, 7, 8]
    assert D.find_leaks(no_docs, bench).count() == 0
    assert D.find_leaks(edge_docs, bench.limit(0)).count() == 0


def test_query_finds_all_literal_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if d.text and b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, SF).collect()}
    assert want <= got
    words = lambda t: set(t.lower().split())
    texts, bench = {d.doc_id: d.text for d in docs}, {b.item_id: b.text for b in items}
    assert all(len(words(bench[k]) & words(texts[i])) >= 8 for i, k in got)


def test_copies_without_literal_words_are_found(spark):
    sums = "12 + 7 = 19 and 30 + 5 = 35 and 44 + 6 = 50 and 81 + 9 = 90"
    names = "Anna Berg, Carl Dahl, Eva Falk, Georg Holm, Ida Juhl, Karin Lind, Max Nord"
    items = [(1, sums), (2, names), (3, "7 8 9"), (4, ITEM)]
    texts = [f"we sum {sums} today", f"we met {names} today", names.lower(), names.upper(), "1 2 3 7 8 9", ITEM.upper(), ITEM.lower(), "1 2 3 7 8 10"]
    found = leaks(spark, texts, items)
    assert set(found) == {(0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (5, 4), (6, 4)}
    assert all(r.changed == 0 and r.share == 1.0 for r in found.values())
    assert set(leaks(spark, texts, items, broadcast_up_to=0)) == set(found)


def test_one_altered_slot_does_not_hide_the_rest(spark):
    story = (f"{ITEM} Later the farmer and Anna walked along the river with 12 more baskets until both of them were tired. "
             "There the quiet miller sold Anna 12 small loaves of bread and told them a story about the winter.")
    other = story.replace("12", "480").replace("Anna", "Miguel").replace("30", "77")
    texts = [
        story.replace("sold Anna", "sold Bob"),                                     # a copy but for one of its repeated names
        other.replace("sold Miguel", "sold Bob"),                                   # the same of a copy with other numbers and names
        ITEM.replace("Anna, how", "Bob, how"),
        "If the old farmer sells 9 apples",
    ]
    found = leaks(spark, texts, [(1, story), (2, ITEM)])
    assert set(found) == {(i, k) for i in (0, 1) for k in (1, 2)} | {(2, 1), (2, 2)}
    assert found[0, 1].share > 0.8 and found[1, 1].share > 0.5 and found[1, 1].changed == 3
    assert found[2, 2].matched >= 17 and found[2, 2].changed <= 1


def test_windows_that_agree():
    a, b = {(1, 1)}, {(1, 2)}
    assert D._consistent([], 4) == []
    assert D._consistent([(0, a), (1, a), (2, b), (3, a)], 4) == [(0, a), (1, a), (3, a)]
    assert D._consistent([(0, {(1, 5), (2, 5)}), (9, {(1, 5)})], 4) == [(9, {(1, 5)})]
    assert D._consistent([(0, a), (1, b), (2, b), (3, set())], 4) == [(1, b), (2, b), (3, set())]
