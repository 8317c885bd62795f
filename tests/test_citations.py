from gleaner.operators import citations as CI


def _run(spark, text, url_sha, prov):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    m = spark.createDataFrame(url_sha or [("x://none", "none")], "url string, content_sha256 string")
    if not url_sha:
        m = m.limit(0)
    p = spark.createDataFrame([(s,) for s in (prov or ["none"])], "content_sha256 string")
    if not prov:
        p = p.limit(0)
    return CI.post_filter(docs, m, p).collect()[0]["filtered"]


BEES = "https://bees.example/hive"


def test_drops_a_claim_without_a_source(spark):
    out = _run(spark, "Hives face south. Wasps pay rent, says https://made-up.example/wasps here. Frames are oiled in March.", [], [])
    assert out == "Hives face south. Frames are oiled in March."


def test_url_in_map_without_provenance(spark):
    assert _run(spark, f"Swarms left early, says {BEES}, in spring.", [(BEES, "sha-b")], []) == ""


def test_tracked_kept(spark):
    text = f"Swarms left early, says {BEES} in its log. Rain came later."
    assert _run(spark, text, [(BEES, "sha-b")], ["sha-b"]) == text


def test_trailing_punctuation_stripped(spark):
    text = f"The log is at {BEES}. Read it twice."
    assert _run(spark, text, [(BEES, "sha-b")], ["sha-b"]) == text


def test_any_untracked_drops_sentence(spark):
    out = _run(spark, f"Both {BEES} and https://made-up.example/wasps say so. Honey sets slowly.", [(BEES, "sha-b")], ["sha-b"])
    assert out == "Honey sets slowly."


def test_empty_text_and_empty_sha(spark):
    assert _run(spark, "", [], []) == ""
    assert _run(spark, "Cite https://e.com/a here. Ok.", [("https://e.com/a", "")], [""]) == "Ok."


def test_nbsp_between_sentences(spark):
    out = _run(spark, "First.\u00a0Second https://bad.example/x. Third.", [], [])
    assert out == "First. Third."


def test_documents_without_or_with_equal_ids_do_not_mix(spark):
    texts = [(None, "One. See https://made-up.example/a for it. Two."), (None, "Plain. Second. Third."),
             (7, "A. B cites https://made-up.example/b here. C."), (7, "D. E. F."), (7, "D. E. F."), (8, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    none = spark.createDataFrame([], "url string, content_sha256 string")
    got = sorted(((r.doc_id, r.filtered) for r in CI.post_filter(docs, none, none).collect()), key=str)
    assert got == sorted([(None, "One. Two."), (None, "Plain. Second. Third."), (7, "A. C."), (7, "D. E. F."),
                          (7, "D. E. F."), (8, None)], key=str)
