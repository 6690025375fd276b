"""Leaks with changed slots, and names written in another way."""

from kelpforge.llm import decontaminate

TAIL = " so how many apples are left over in the old wooden box after they all went home to sleep"


def found(spark, item, *docs):
    texts = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    return {r.doc_id: r.verbatim for r in decontaminate.contaminated(texts, items).collect()}


def test_two_values_may_take_the_same_new_value(spark):
    item = "a train goes 30 km in 2 hours" + TAIL
    assert found(spark, item, item.replace("30", "5").replace("2 hours", "5 hours")) == {0: False}


def test_one_changed_digit_does_not_hide_a_copy(spark):
    item = "they paid 30 coins for the cart and much later" + TAIL + " while 30 coins were lost on the way back to the small town by the river near the bridge"
    assert found(spark, item, item.replace("while 30", "while 31")) == {0: False}
    many = "anna counted 30 red apples bert sold 30 green pears carl lost 30 blue plums dora found 30 black cherries"
    assert found(spark, many, many.replace("30 red", "1 red").replace("30 green", "2 green").replace("30 blue", "3 blue")) == {}


NAMES = "Yesterday Alice drove over the hill with Bob, and after a long rest they met Carol again near the lake and Dan too."


def test_names_in_other_case_or_after_other_white_space(spark):
    wrapped = NAMES.replace(" Alice", "\nAlice").replace(" Bob", "\tBob").replace(" Carol", "  Carol").replace(" Dan", " \n Dan")
    assert found(spark, NAMES, wrapped, NAMES.lower(), NAMES.upper(), NAMES.title()) == dict.fromkeys(range(4), True)
    assert found(spark, NAMES.lower(), NAMES) == {0: True}
    assert found(spark, NAMES, NAMES.replace("Alice", "Eve").replace("Bob", "Finn")) == {0: False}


SOLD = "Natalia sold clips to 48 of her friends in April, and then Natalia sold half as many clips in May. How many clips did Natalia sell in all?"


def test_names_at_the_start_of_a_sentence_are_slots(spark):
    asked = SOLD.replace("Natalia", "Bob").replace("48", "60").replace("April", "June").replace("May", "July")
    mixed = asked.replace("did Bob", "did Carl").replace("then Bob", "then Dan")
    other = "Natalia bought 48 clips. Her friends sold them in May, and then she went home to sleep for half of the day."
    assert found(spark, SOLD, "Please answer this. " + asked, asked.replace("Bob", "Natalia"), other) == {0: False, 1: False}
    assert 0 not in found(spark, SOLD, mixed)


def test_short_items(spark):
    """Inside longer texts word for word, as whole texts with other slots too; below three tokens as whole texts only."""
    assert found(spark, "What is 2+2?", "So tell me: what is 2 + 2, please?", "What is 2 + 3 then?", "what is 7+7", "what is 7+8", "what was it") == {0: True, 2: False}
    assert found(spark, "Paris", "We went to Paris once", "paris!", "London") == {1: True, 2: False}


def test_tables_of_numbers_meet_no_item_by_themselves(spark):
    table = " ".join(str(k) for k in range(3000))
    item = "add 1 2 3 4 5 6 7 8 and tell which of them are odd numbers in this list"
    assert found(spark, item, table, table + " " + item + " " + table, table.replace("7", "x")) == {1: True}


def test_reparameterised_questions_planted_in_texts(spark):
    """Of fifty items asked again with other names, numbers and units, inside other text, all are found and nothing else."""
    import random

    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    name = lambda: word().capitalize()

    def question(texts, n, m, a, b, unit):
        return f"{a} has {n} {unit} of {texts[0]} and gives {m} {unit} of it to {b}. {' '.join(texts[1:])} How much does {a} have after {b} went home?"

    shapes = [[word() for _ in range(12)] for _ in range(50)]
    fill = lambda: (draw.randint(2, 99), draw.randint(100, 999), name(), name(), draw.choice(["km", "kg", "litres"]))
    items = [(k, question(t, *fill())) for k, t in enumerate(shapes)]
    docs = [(k, " ".join(word() for _ in range(30)) + ". " + question(t, *fill()) + " " + " ".join(word() for _ in range(30))) for k, t in enumerate(shapes)]
    docs += [(100 + k, question([word() for _ in range(12)], *fill())) for k in range(50)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(50)}


def test_clashing_names_nulls_and_long_texts(spark):
    docs = spark.createDataFrame([(None, SOLD), (1, None), (1, ""), (2, "word " * 200_000 + SOLD)], "doc_id long, text string")
    for name in ("__row", "__held", "key", "hash", "item", "at"):
        docs = docs.selectExpr("*", f"1 AS {name}")
    items = spark.createDataFrame([(None, SOLD), (3, SOLD), (3, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(None, None), (None, 3), (2, None), (2, 3)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] in ([None, ""], ["", None])


def test_windows_around_names_come_twice_and_only_those_are_hashed_twice(spark):
    text = "we saw Ann and 3 kg in May of the year Minutes ago"
    df = decontaminate.windows(spark.createDataFrame([(1, text), (2, "no name is in here at all"), (3, "Ann is")], "key long, text string"), [5, 2], whole_only=False)
    words = text.split()
    named = [i for i in range(len(words) - 4) if any(w[0].isupper() for w in words[i : i + 5])]
    got = sorted((r.key, r.at) for r in df.collect())
    assert got == sorted([(1, i) for i in range(len(words) - 4)] + [(1, i) for i in named] + [(2, i) for i in range(3)] + [(3, 0)] * 2)
    slots = [r.slots for r in df.where("key = 1").collect()]
    assert any("#nameminutes" in x for x in slots) and any("#unitminutes" in x for x in slots)
    # All places of a text are gone through once for each width.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(0, (n") == 2
