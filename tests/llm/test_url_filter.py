from rasterloom.llm.url_filter import RULES, judge


def rows_of(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_rules_hosts_and_paths(spark):
    urls = {
        "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2#f": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", "com/de/", "block"),
        "http://x.com": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "ftp://h?x://y": ("h", "", None, "allow"),
    }
    got = {r.page_id: r for r in judge(rows_of(spark, urls), RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == list(urls.values())


def test_impure_branch_is_rejected_and_clean_one_is_not(spark):
    urls = [f"http://h.com/de/{i}" for i in range(40)] + [f"http://h.com/fr/{i}" for i in range(40)] + [f"http://h.com/en/{i}" for i in range(40)]
    rules = [("block", "h.com", f"/bad/{i}") for i in range(10)] + [("allow", "h.com", "/fr/")]
    urls += [f"http://h.com/bad/{i}/x" for i in range(10)] + ["http://h.com/bad/z/x"] * 2
    got = judge(rows_of(spark, urls), rules).collect()
    seen = {}
    for r in got:
        seen.setdefault((urls[r.page_id].split("/")[3], r.rule is None), set()).add(r.verdict)
    assert seen["en", True] == seen["de", True] == {"allow"} and seen["fr", False] == {"allow"}
    assert seen["bad", False] == {"block"} and len(got) == len(urls)


def test_empty(spark):
    assert judge(rows_of(spark, []).limit(0), RULES).collect() == []


def test_templates_go_below_the_third_segment(spark):
    """A slug at the third segment; the fourth and fifth tell good from bad."""
    rules = [("block", "h", f"/a/b/s{chr(97 + k)}/x/bad") for k in range(20)] + [("allow", "h", f"/a/b/s{chr(97 + k)}/x/good") for k in range(20)]
    urls = [f"http://h/a/b/s{chr(97 + k)}/x/{end}" for k in range(20) for end in ("good", "bad")]
    urls += ["http://h/a/b/other/x/bad", "http://h/a/b/other/x/good", "http://h/a/b/alone"]
    from rasterloom.llm.url_filter import judge

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: (r.verdict, r.template.split("/")[4:]) for r in judge(df, rules).collect()}
    assert len(got) == len(urls)
    assert got["http://h/a/b/other/x/bad"] == ("block", ["*", "bad"])
    assert got["http://h/a/b/other/x/good"] == ("allow", ["*", "good"])
    assert got["http://h/a/b/alone"][1] == []


def test_a_column_of_labels_is_evidence_where_no_rule_fits(spark):
    """Labelled pages condemn the template, so unlabelled ones fall too; a rule's verdict stands."""
    rows = [(i, f"http://h/spam/{i}", "block" if i < 12 else None) for i in range(15)]
    rows += [(20 + i, f"http://h/news/{i}", "allow" if i < 12 else "unsure") for i in range(15)] + [(40, "http://h/spam/kept", "block")]
    df = spark.createDataFrame(rows, "page_id long, url string, `the.label` string")
    rules = [("allow", "h", "/spam/kept")]
    with_labels = {r.page_id: r.verdict for r in judge(df, rules, "the.label").collect()}
    assert [with_labels[i] for i in (0, 12, 14, 20, 34, 40)] == ["block", "block", "block", "allow", "allow", "allow"]
    assert {r.verdict for r in judge(df, rules).collect()} == {"allow"}
