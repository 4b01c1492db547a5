import re

from lodestone.llm import licenses as L

TEXTS = {
    1: None,
    2: "",
    3: "Released under the MIT License. All rights reserved.",
    4: "mit  license, MIT\nLICENSE; cc-by; Cc\tBY-NC 4.0",
    5: "This work is licensed under the GNU General Public License, version 3.",
    6: "Licensed under the Apache License, Version 2.0.",
    7: "mit éa license; K license",
    8: "the " * 30_000 + "apache license",
    9: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    10: "license " * 20_000 + "gnu general public",
    11: "gnu gnu general public license license",
    12: "word-mit-license-mit license",
    13: "mit " * 200_000 + "license",
    14: "mit license " * 50_000,
    15: "apache apache license license apache license",
}


def brute(text):
    words = re.findall(L.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark, tmp_path):
    rows = [(k, t, "x") for k, t in TEXTS.items()] + [(3, TEXTS[3], "y"), (None, "MIT license", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op1_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS.get(r.doc_id, "MIT license"))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].labels == "mit,proprietary" and by_id[5].labels == "gpl,gpl-3.0" and by_id[6].labels == "apache,apache-2.0"
    assert by_id[9].labels == "mit" and by_id[9].n_base == 0 and by_id[9].score == 1.0 and by_id[2].score == 0.0
    assert by_id[4].labels == "cc-by,cc-by-nc,mit"


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert L.op1_license_scan(spark, str(tmp_path)).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = L.op1_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
