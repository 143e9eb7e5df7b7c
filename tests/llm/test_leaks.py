import pytest

from palimpsa.llm import leaks

ITEM = "Last summer Tom walked 12 km from the old mill to Ravenna in 3 hours and Tom said that 12 km were enough for him."


@pytest.fixture(scope="module")
def items(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, "k", "x") for i, t in rows], "item_id long, text string, _key string, found string")

    return build


def pairs(frame):
    return sorted((r.doc_id, r.item_id, r.same_slots) for r in frame.collect())


def test_plain_and_changed_copies(docs, items, prose):
    changed = ITEM.replace("Tom", "Ann").replace("12", "40").replace("Ravenna", "Siena").replace("3 hours", "5 hours")
    clash = changed.replace("40 km were", "41 km were")
    rows = [
        (1, prose(1, 40) + ". " + ITEM + " " + prose(2, 40)), (2, prose(3, 30) + ".\n" + changed + "\n" + prose(4, 30)),
        (3, prose(5, 30) + ". " + clash), (4, prose(6, 200)), (5, ITEM[: len(ITEM) // 2] + prose(7, 30)),
        (6, ITEM.upper()), (7, None), (8, ""), (9, ITEM + " " + ITEM),
    ]
    got = {(d, i): s for d, i, s in pairs(leaks.find_leaks(docs(rows), items([(0, ITEM), (1, None), (2, "")])))}
    assert got[1, 0] is True and got[9, 0] is True
    assert got[2, 0] is False
    assert not {(3, 0), (4, 0), (5, 0), (7, 0), (8, 0)} & set(got)


def test_short_items_match_whole_texts_only(docs, items):
    got = pairs(leaks.find_leaks(docs([(1, "two words"), (2, "two words more"), (3, "Two  words!")]), items([(0, "two words")])))
    assert got == [(1, 0, True), (3, 0, True)]


def test_short_items_inside_of_texts(docs, items, prose):
    bench = [(0, "Who wrote Middlemarch?"), (1, "Name 3 rivers"), (2, "Capital of France"), (3, "Paris")]
    rows = [
        (1, prose(1, 30) + ". Who wrote Middlemarch? " + prose(2, 30)), (2, prose(3, 30) + ". Who wrote Emma? " + prose(4, 9)),
        (3, "who wrote Middlemarch"), (4, prose(5, 20) + ". name 3 rivers " + prose(6, 20)), (5, "name 4 rivers"),
        (6, prose(7, 20) + ". Capital of France, says " + prose(8, 2)), (7, "In Paris " + prose(9, 20)), (8, "Paris"),
        (9, "Name 3"), (10, None),
    ]
    got = pairs(leaks.find_leaks(docs(rows), items(bench)))
    assert got == [(1, 0, True), (3, 0, True), (4, 1, True), (6, 2, True), (8, 3, True)]


def test_placeholders_alone_tell_nothing(docs, items, prose):
    rows = [
        (1, "pages 1, 3, 5, 7, 9, 11, 13 were missing"), (2, prose(1, 20) + " 2, 4, 8, 16, 32, 64 " + prose(2, 20)),
        (3, prose(3, 20) + " 3, 9, 27, 81, 243, 729 " + prose(4, 20)), (4, "1 2 3 4 5 6 7 8 9"),
    ]
    assert pairs(leaks.find_leaks(docs(rows), items([(0, "2, 4, 8, 16, 32, 64")]))) == [(2, 0, True)]


def test_same_result_when_windows_are_shuffled(docs, items, prose, monkeypatch):
    bench = [(i, prose(50 + i, 30)) for i in range(20)]
    rows = [(i, prose(500 + i, 50) + ". " + bench[i % 20][1]) if i % 3 == 0 else (i, prose(500 + i, 80)) for i in range(120)]
    first = pairs(leaks.find_leaks(docs(rows), items(bench)))
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", 0)
    assert pairs(leaks.find_leaks(docs(rows), items(bench))) == first
    assert {d for d, _, _ in first} == set(range(0, 120, 3))


def test_repeated_rows_and_missing_keys(docs, items, prose):
    text = prose(1, 60)
    rows = [(1, text), (1, text), (None, text), (2, prose(2, 60))]
    got = leaks.find_leaks(docs(rows), items([(0, text), (0, text), (7, text)])).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 0), (-1, 7), (1, 0), (1, 7)]
    out = leaks.drop_leaks(docs(rows), items([(0, text)]))
    assert [r.doc_id for r in out.collect()] == [2] and out.columns == docs(rows).columns


def test_empty_tables(docs, items):
    assert pairs(leaks.find_leaks(docs([]), items([(0, ITEM)]))) == []
    assert pairs(leaks.find_leaks(docs([(1, ITEM)]), items([]))) == []


APPLES = "Tom has 3 apples. Tom buys 5 more apples from his friend Ann. Tom then eats 2 apples. How many apples does Tom have now?"
TRAIN = (
    "A train leaves the old station at 9 and runs 120 kilometers to the coast. It carries 40 kilograms of mail for each "
    "5 kilometers of track. How many kilograms does it carry after 12 m of the last bridge?"
)


def test_names_at_starts_of_sentences(docs, items, prose):
    renamed = APPLES.replace("Tom", "Sue").replace("Ann", "Bob").replace("3", "14").replace("5", "6").replace("2", "9")
    rows = [
        (1, prose(1, 30) + ". " + renamed + " " + prose(2, 30)), (2, prose(3, 30) + ". " + APPLES),
        (3, prose(4, 30) + " how many tom then. " + renamed), (4, APPLES.replace("How", "how").replace("Tom buys", "tom buys")),
        (5, prose(5, 30) + ". Then Sue has many apples. Sue eats them."),
    ]
    got = {d: s for d, _, s in pairs(leaks.find_leaks(docs(rows), items([(0, APPLES)])))}
    assert {1: False, 2: True, 3: False}.items() <= got.items() and 5 not in got


def test_units_by_full_names_and_letters(docs, items, prose):
    changed = TRAIN.replace("kilometers", "miles").replace("kilograms", "pounds").replace("12 m ", "12 ft ")
    rows = [(1, prose(1, 30) + ". " + changed), (2, prose(2, 30) + ". " + changed.replace("pounds", "bags"))]
    assert pairs(leaks.find_leaks(docs(rows), items([(0, TRAIN)]))) == [(1, 0, False)]


def test_copies_that_move_or_merge_values(docs, items, prose):
    longer = ITEM.replace("Ravenna", "San Marino").replace("Tom", "Mary Ann").replace("12", "40")
    more = APPLES.replace("Tom", "Mary Ann").replace("Ann.", "Bob Roe.").replace("3", "1 200")
    merged = APPLES.replace("Tom", "Sue").replace("3", "4").replace("5", "4")
    old = " ".join(f"{w} Ida" if i % 12 == 11 else w for i, w in enumerate(prose(9, 60).split()))
    extra = old.replace("Ida", "Eva").split()
    extra.insert(25, "really")
    twice = ITEM.replace("Tom", "Ann") + " " + prose(12, 3) + ". " + ITEM.replace("Tom", "Bob").replace("12", "7")
    rows = [
        (1, prose(1, 30) + ". " + longer), (2, prose(2, 30) + ". " + more), (3, prose(3, 30) + ". " + merged),
        (4, prose(4, 30) + " " + " ".join(extra) + " " + prose(5, 30)), (5, twice),
        (6, prose(6, 30) + ". " + ITEM.replace("12 km from", "13 km from").replace("3 hours", "8 sacks")),
    ]
    got = pairs(leaks.find_leaks(docs(rows), items([(0, ITEM), (1, APPLES), (2, old)])))
    assert got == [(1, 0, False), (2, 1, False), (3, 1, False), (4, 2, False), (5, 0, False)]


def test_only_rows_with_leaks_go(docs, items, prose):
    bad = prose(1, 60)
    rows = [(None, bad), (None, prose(2, 60)), (3, bad), (3, prose(3, 60)), (4, prose(4, 60)), (4, None), (None, None)]
    out = leaks.drop_leaks(docs(rows), items([(0, bad)]))
    key = lambda r: (r[0] or -1, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([r for r in rows if r[1] != bad], key=key)
