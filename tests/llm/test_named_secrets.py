"""Random values behind a name and '='."""

import base64
import hashlib

from pyspark.sql import functions as F

from flowmill.llm import secrets


def test_value_behind_an_equals_sign(spark):
    key = lambda i: base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode()
    rows, want = [], {}
    for i, (before, pad, behind) in enumerate([
            ("sig=", "", ""), ("set AccountKey=", "=", ";"), ("GITHUB_PAT=", "", " x"), ("/a?auth=", "", "&b=c"),
            ("a_rather_long_name_of_a_setting=", "=", ""), ("see ", "=", " here"), ("x==", "", "")]):
        value = key(i).rstrip("=") + pad
        rows.append((i, before + value + behind))
        want[i] = f"random:{len(before)}:{len(before) + len(value)}"
    rows += [(90, "name=internationalisationalities"), (91, "=" * 50), (92, "a=b=c=d=e=f=g=h=i=j=k=l=m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.scan(docs).select("doc_id", secrets.render(F.col("spans")).alias("s")).collect()}
    assert got == want | {90: "", 91: "", 92: ""}
