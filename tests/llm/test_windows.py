from __future__ import annotations

from isobar.llm import decontaminate


def test_copies_whose_parts_changed_places_are_found(spark):
    words = [f"w{k}" for k in range(60)]
    item, swapped = " ".join(words), " ".join([*words[30:], *words[:30]])
    docs = spark.createDataFrame(
        [(1, f"{'some other ' * 40}{swapped}{' and some after it' * 20}"), (2, swapped),
         (3, " ".join(words[30:]) + " a b c d e f g h i j k l m n " + " ".join(words[:30])),
         (4, f"x y {item} z")], "doc_id int, text string")
    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    got = {r["doc_id"]: (r["start"], round(r["similarity"], 4))
           for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: (80, round(52 / 56, 4)), 2: (0, round(52 / 56, 4)), 4: (2, 1.0)}
