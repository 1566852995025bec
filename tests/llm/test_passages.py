"""Passages of benchmark items that are dense in numbers, edited in one place, or start with names."""

from opinaria.llm import decontaminate


def hits(spark, texts, items, docs):
    known = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.contaminated(texts(list(enumerate(docs))), known)
    return {(r["doc_id"], r["item_id"]): r for r in found.collect()}


def test_verbatim_items_full_of_numbers(spark, texts):
    items = ["What is 12 + 45 + 7 - 3 + 9?", "Add 3, 8, 21, 34 and 55 now please",
             "Take the list 4 8 15 16 23 42 7 9 11 13 and then say which of these values is the largest"]
    docs = [f"Some prose. {item} More prose follows." for item in items]
    docs += ["Some prose. What is 12 + 45 + 7 - 3 + 8? More.", "prose 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"]
    got = hits(spark, texts, items, docs)
    assert set(got) == {(0, 0), (1, 1), (2, 2)} and all(r["exact"] for r in got.values())


def test_one_edited_number_leaves_the_rest_of_a_long_passage(spark, texts):
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}word" for k in range(50)]
    words[5], words[20], words[44] = "5", "3", "5"
    item = " ".join(words)
    changed, equal, both = list(words), list(words), list(words)
    changed[44] = "7"
    equal[20] = "5"
    both[5], both[20], both[44] = "4", "4", "4"
    got = hits(spark, texts, [item], [item, " ".join(changed), " ".join(equal), " ".join(both)])
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0)} and all(r["exact"] for r in got.values())
    assert got[(1, 0)]["n_words"] == 44 and got[(0, 0)]["n_words"] == 50


def test_names_that_begin_sentences_and_names_of_two_words(spark, texts):
    item = ("Tom has 3 red apples in a bag. Tom buys 5 more of them at the shop. Tom gives 2 of all his apples away. "
            "Tom then travels from Paris to see the sea. How many apples does Tom have left?")
    other = ("Anna has 4 red apples in a bag. Anna buys 6 more of them at the shop. Anna gives 1 of all his apples away. "
             "Anna then travels from New York to see the sea. How many apples does Anna have left?")
    mixed = other.replace("Anna gives", "Bob gives").replace("Anna buys", "Tim buys").replace("Anna then", "Eve then")
    got = hits(spark, texts, [item], [other, mixed])
    assert set(got) == {(0, 0)} and not got[(0, 0)]["exact"] and got[(0, 0)]["n_words"] > 30
