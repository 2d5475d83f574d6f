"""Cases of the advice on the text operators: rows that the operators once lost, kept or found too few of."""

import random
import zlib

from test_text_operators import docs_of, jac, sentence, shingle_set

from factorlake.llm import decontam, jaccard, langid

NATURAL = {"en": "the and thing with other house water never from which their people", "de": "der und nicht schön über haus wasser niemals von welche ihre leute", "zu": "𞤀𞤁𞤂 𞤃𞤄𞤅 𞤆𞤇 𞤀𞤃𞤂𞤁 𞤂𞤂𞤀 𞤆𞤄"}


def test_language_stage_rejects_by_distance(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(NATURAL[lang].split()) for _ in range(r.randint(1, 40))), lang) for i in range(240) for lang in [list(NATURAL)[i % 3]]]
    junk = ["это было не так", "这是一个中文文本", "xqzjv kwpfg zzxq vbnmq qwrtp jkxvz", "😀😀 🎉", "12 😀 !!", None, ""]
    docs = docs_of(spark, [*rows, *((1000 + i, t, None) for i, t in enumerate(junk)), (2000, "the people with water", None)])
    assert {x.doc_id for x in langid.keep_identified(docs).collect()} == {*range(240), 2000}
    # the only labelled rows are held out of op 3
    only = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    docs = docs_of(spark, [(i, NATURAL["en"], "en") for i in only] + [(9000, "the house", None), (9001, "это было", None)])
    assert {x.doc_id for x in langid.keep_identified(docs).collect()} == {*only, 9000}
    docs = docs_of(spark, [(1, sentence(1, 9), None), (2, "😀", None), (3, "𞤀𞤁", None), (4, None, None)])
    assert {x.doc_id for x in langid.keep_identified(docs).collect()} == {1, 3}


def test_letters_are_decided_by_code_point():
    assert [len(x) for x in langid.gram_counts(["😀 🎉", "\ud83d"])] == [0, 0, 0]
    assert set(langid.gram_counts(["😀", "𞤀", "a"])[0].tolist()) == {1, 2}


def near(text: str, at: int) -> str:
    words = text.split(" ")
    return " ".join([*words[:at], "changed", *words[at + 1 :]])


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (sentence(300 + i, 80) for i in range(5))
    rows = [
        (None, a, "en"), (None, near(a, 40), "en"), (None, b, "en"), (1, c, "en"), (1, near(c, 40), "en"), (1, d, "en"), (None, near(d, 9), "en"),
        (None, None, "en"), (None, "", "en"), (2, e, "en"), (2, e, "en"), (None, e, "en"), (None, e, "en"), (3, "!!", "en"),
    ]
    docs = docs_of(spark, rows)
    sets = [shingle_set(t) for _, t, _ in rows]
    links = [sum(1 for j, o in enumerate(sets) if j != i and jac(s, o) >= 0.8) for i, s in enumerate(sets)]
    got = jaccard.jaccard_classes(docs).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(rows[i][0]), n) for i, n in enumerate(links))
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == sorted(["None"] * 5 + ["1", "2", "2"])
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) == 8
    assert sum(x in kept for x in ((None, a), (None, near(a, 40)))) == 1 == sum(x in kept for x in ((1, c), (1, near(c, 40))))
    assert {(None, b), (1, d), (None, None), (None, ""), (2, e), (3, "!!")} < set(kept) and (None, e) not in kept and (None, near(d, 9)) not in kept


def test_decontamination_with_null_and_repeated_ids(spark):
    item, other, nameless = sentence(400, 20), sentence(401, 20), sentence(402, 20)
    clean = [sentence(410 + i, 50) for i in range(3)]
    table = spark.createDataFrame([(1, item), (2, sentence(403, 20)), (2, other), (None, nameless)], "item_id long, text string")
    holds = [f"{clean[0]} {x} {clean[1]}" for x in (item, other, nameless)]
    docs = docs_of(spark, [(None, holds[0], "en"), (None, clean[0], "en"), (7, holds[1], "en"), (7, clean[1], "en"), (8, holds[2], "en"), (9, clean[2], "en"), (None, None, "en")])
    left = [(r.doc_id, r.text) for r in decontam.decontaminate(docs, table).collect()]
    assert len(left) == 4 and set(left) == {(None, clean[0]), (7, clean[1]), (9, clean[2]), (None, None)}
    assert {(r.doc_id, r.item_id, r.containment) for r in decontam.contamination(docs, table).collect()} == {(None, 1, 1.0), (7, 2, 1.0), (8, None, 1.0)}
