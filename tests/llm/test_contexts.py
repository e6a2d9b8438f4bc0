"""Personal data found through contexts that hold no base span."""

from rowferry.llm import pii


def test_personal_data_spreads_over_two_contexts(spark):
    """Seeds make a context, its values a second one that holds no base span."""
    first = [f"please call me under +1 487 555 {i:04d} today" for i in range(90)]
    first += [f"please call me under 487 666 {i:04d} today" for i in range(6)]
    second = [f"kindly reach me at 487 666 {i:04d} tonight" for i in range(6)]
    second += ["kindly reach me at 487 777 0001 tonight", "number of parts 487 777 0002 stored"]
    rows = list(enumerate(first + second))
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] for i in range(103))
    assert found[102] == "phone:19:31" and found[103] == ""
