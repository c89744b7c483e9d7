"""op10: main text of all pages. SQL cannot express it: tested against small pages with known text."""

from pyspark.sql import functions as F

from gridwash.llm.html import extract_text
from gridwash.llm.queries import query


@query("op10_html")
def op10_html(t):
    found = extract_text(t.pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
