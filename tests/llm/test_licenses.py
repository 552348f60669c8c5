import re

import fixtures

from nudgeline.llm import license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = WORD.findall((text or "").translate(fixtures.LOWER))
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
    )


def test_base_places(spark):
    extra = [
        "MIT License",
        "mit-license mit license. MIT\nLICENSE",
        "general public license general public",
        "the mit general public license apache license",
        "MIT Licensee and commit license",
        "mıt license MİT LICENSE",
        "x " * 5000 + "Apache License",
    ]
    rows = [(r[0], r[1]) for r in fixtures.texts()] + [(900 + i, t) for i, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    found = fixtures.by_id(license_scan.scan(docs))
    for doc_id, text in rows:
        r = found[doc_id]
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert got == plain_base(text), text
        assert 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}


def test_notices_survive_small_edits(spark):
    notice = license_scan.NOTICES[1][0]
    words = notice.split()
    cases = {
        1: ("mit", f"Before. {notice.title()}, after."),
        2: ("mit", " ".join([*words[:8], "surely", *words[8:]])),  # a word put in
        3: ("mit", " ".join(words[:9] + words[10:])),  # a word left out
        4: ("", " ".join(words[:6])),  # too little of it
        5: ("", " ".join(words[::-1])),
        6: ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
        7: ("", ""),
    }
    docs = spark.createDataFrame([(i, t) for i, (_, t) in cases.items()], "doc_id BIGINT, text STRING")
    found = fixtures.by_id(license_scan.scan(docs))
    assert {i: r["labels"] for i, r in found.items()} == {i: label for i, (label, _) in cases.items()}
    assert found[1]["score"] == 1.0 and found[7]["score"] == 0.0
    assert found[2]["score"] > 0.85


def test_templates_of_any_length(spark):
    words = [f"w{i}" for i in range(200)]
    table = license_scan.templates(spark, base=[(" ".join(words[:100]), "x")], notices=[(" ".join(words), "y")])
    texts = [words, words[:90] + ["put", "in"] + words[90:], words[:100], words[:60] + words[70:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    found = license_scan.spans(license_scan.votes(docs, table=table)).where("found").collect()
    assert {(r["doc_id"], r["label"]) for r in found} == {(0, "x"), (0, "y"), (1, "y"), (2, "x")}
    covers = {r["doc_id"]: r["cover"] for r in found if r["label"] == "y"}
    assert covers == {0: 1.0, 1: 198 / 199}


def test_only_engine_operations(spark):
    plan = license_scan.scan(fixtures.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
