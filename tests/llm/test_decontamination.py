from gleanery.llm.decontamination import clean_documents, contaminated, judged_documents, unmatchable_items

ITEM = "A train leaves Paris at 9 with 120 people and goes 80 km each hour until it meets Anna near the old bridge"
LONG = "first words of another story that has nothing in common with any item at all and goes on"


def frames(spark, docs, items=((1, ITEM), (2, "short item of five words"), (3, None))):
    return spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(list(items), "item_id long, text string")


def test_verbatim_reworded_and_clean(spark):
    other = ITEM.replace("Paris", "Rome").replace("120", "1,500").replace("80 km", "30 miles").replace("Anna", "Otto")
    mixed = "a bus of Paris at 9 with 120 people or none, and then some other words that no item holds"
    rows = [(1, f"{LONG}. {ITEM}. {LONG}", "x"), (2, f"{LONG}. {other}.", None), (3, LONG, ""), (4, mixed, ""), (5, None, None), (6, "", ""), (None, ITEM, ""), (7, f"so: short item of five words, {LONG}", ""), (8, ITEM.lower(), ""), (8, LONG, "")]
    docs, items = frames(spark, rows)
    found = {(r.doc, r.item): r for r in contaminated(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (7, 2), (8, 1)}
    assert not found[1, 1].reworded and found[2, 1].reworded and found[1, 1].cover > 0.8
    assert sorted(r.doc_id for r in clean_documents(docs, items).filter("doc_id IS NOT NULL").collect()) == [3, 4, 5, 6]
    judged = judged_documents(docs, items).collect()
    assert len(judged) == len(rows) and {r.doc_id for r in judged if r.contaminated} == {1, 2, 7, 8}


def test_inconsistent_slots_are_no_leak(spark):
    item = "take 5 of the red ones and 5 of the blue ones then add 5 of the green ones to the pile"
    docs, items = frames(spark, [(1, item.replace("5", "7"), ""), (2, "take 5 of the red ones and 6 of the blue ones then add 9 of the green ones to the pile", "")], [(1, item)])
    assert {r.doc for r in contaminated(docs, items).collect()} == {1}


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, ITEM, "")])
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0
    assert judged_documents(docs, items.limit(0)).first().n_items == 0


def test_swapped_names_in_any_position(spark):
    item = "Anna has 5 pens. Anna buys 3 pens. Tom Brown takes 2 pens. Anna Smith met Bob Brown and gave 1 pen to each."
    swapped = "Maria has 8 pens. Maria buys 6 pens. Jim Black takes 4 pens. Maria Jones met Carl Black and gave 9 pen to each."
    mixed = "Maria has 8 pens. Carl buys 6 pens. Jim Black takes 4 pens. Eve Jones met Rob White and gave 9 pen to each."
    titles = "The Old House Of The North And The Long Way To The Blue Lake With Many New Boats Of Good Wood"
    rows = [(1, f"we read: {swapped} so", ""), (2, swapped, ""), (3, mixed.replace("pens", "books").replace("met", "saw"), ""), (4, item.lower(), ""), (5, item, ""), (6, titles, "")]
    items = [(1, item), (2, "Some Other Names Stand Here In One Row And Each Of Them Is Written So"), (3, "anna and bob walk to the old house by the lake")]
    rows.append((7, "then Anna and Bob walk to the old House by the Lake", ""))
    rows.append((8, f"we read: {swapped[:31].lower().replace('maria', 'Maria')} {swapped[32:]}".replace(". ", ", ") + " so", ""))  # no head of a sentence
    docs, benchmark = frames(spark, rows, items)
    assert {(r.doc, r.item) for r in contaminated(docs, benchmark).collect()} == {(1, 1), (2, 1), (4, 1), (5, 1), (7, 3), (8, 1)}


def test_items_of_too_few_words_match_nothing_and_are_listed(spark):
    items = [(1, "42"), (2, "Yes"), (3, "Anna has 5 pens"), (4, "3 + 5 = 8 and 7 + 9 = 16"), (5, ""), (6, None), (7, "what colour has snow")]
    rows = [(1, "42 is a number, yes", ""), (2, "Yes", ""), (3, "Bob has 3 pens", ""), (4, "1 + 2 = 3 and 4 + 5 = 9", ""), (5, "he asked: what colour has snow?", "")]
    docs, benchmark = frames(spark, rows, items)
    assert {(r.doc, r.item) for r in contaminated(docs, benchmark).collect()} == {(5, 7)}
    assert {r.item_id for r in unmatchable_items(benchmark).collect()} == {1, 2, 3, 4, 5, 6}


def test_a_large_benchmark_meets_in_a_shuffled_join(spark):
    other = ITEM.replace("Paris", "Rome").replace("120", "1,500")
    docs, items = frames(spark, [(1, f"{LONG}. {ITEM}", "x"), (2, other, ""), (2, LONG, ""), (3, LONG, ""), (3, other, ""), (3, other, "")])
    ways = [sorted(tuple(r) for r in contaminated(docs, items, most_broadcast=most).collect()) for most in (1, 1000)]
    assert ways[0] == ways[1] and {r[0] for r in ways[0]} == {1, 2, 3}


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"word{k % 997} other{k % 31}" for k in range(30_000))
    docs, items = frames(spark, [(1, f"{long} {ITEM} {long}", "x"), (1, f"{long} {ITEM} {long}", "x"), (2, "a" * 300_000, ""), (3, long, "")])
    assert {r.doc for r in contaminated(docs, items).collect()} == {1}
    assert len(clean_documents(docs, items).collect()) == 2


def test_number_words_lists_capitals_and_decimals(spark):
    items = [
        (1, "The farmer owns three red barns and two old sheds, and twenty-five sheep graze behind the long fence every morning"),
        (2, "Sort the list 1,2,3 and then the list 4,5,6 before you add both of them to the table of results"),
        (3, "When NASA sent a probe to the MOON the crew at ESA watched it land on the screens of the hall"),
        (4, "A rope of 1.5 meters is cut in 15 parts and each part is as long as the thumb of the boy"),
    ]
    rows = [
        (1, "The farmer owns five red barns and nine old sheds, and forty sheep graze behind the long fence every morning"),
        (2, "so: Sort the list 10,20,30 and then the list 7,8,12 before you add both of them to the table of results"),
        (3, "When JAXA sent a probe to the MARS the crew at IBM watched it land on the screens of the hall"),
        (4, "A rope of 2.25 meters is cut in 9 parts and each part is as long as the thumb of the boy"),
        (5, "A rope of 15 meters is cut in 1.5 parts and each part is as long as the thumb of the boy"),
        (6, "The farmer owns Three red barns and 2 old sheds, and 1,250 sheep graze behind the long fence every morning"),
        (7, "Nobody owns a barn or two of the sheds, and no list of three or five numbers says when the probe of the crew will land"),
    ]
    docs, benchmark = frames(spark, [(*r, "") for r in rows], items)
    found = {(r.doc, r.item): r.reworded for r in contaminated(docs, benchmark).collect()}
    assert found == {(1, 1): True, (2, 2): True, (3, 3): True, (4, 4): True, (5, 4): True, (6, 1): True}


def test_a_point_is_part_of_a_value(spark):
    """One slot can't be 1.5 here and 15 there."""
    item = "take 1.5 liters of the red paint and 1.5 liters of the blue paint and stir the mix for a long time"
    docs, benchmark = frames(spark, [(1, item.replace("1.5", "15"), ""), (2, item.replace("1.5 liters of the red", "15 liters of the red"), "")], [(1, item)])
    assert {r.doc for r in contaminated(docs, benchmark).collect()} == {1}


def test_extra_columns_of_operator_names(spark):
    docs, items = frames(spark, [(1, ITEM, "x"), (2, LONG, "y"), (3, None, None)])
    clash = docs.toDF("doc_id", "text", "item").selectExpr("*", "1 AS h", "2 AS t", "3 AS way", "4 AS size", "5 AS doc", "6 AS n", "7 AS at")
    kept = clean_documents(clash, items.selectExpr("*", "1 AS item", "2 AS words"))
    assert kept.columns == clash.columns and sorted((r.doc_id, r.item, r.t) for r in kept.collect()) == [(2, "y", 2), (3, None, 2)]
    assert {r.doc_id for r in judged_documents(clash, items).collect() if r.contaminated} == {1}
