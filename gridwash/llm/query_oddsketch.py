"""op13: near-duplicate components of all documents by the similarity of their two-word shingles. SQL would have to compare
all pairs that share a shingle: tested against brute force."""

from gridwash.llm.oddsketch import near_duplicates
from gridwash.llm.queries import query


@query("op13_oddsketch")
def op13_oddsketch(t):
    return near_duplicates(t.documents).withColumnsRenamed({"id": "doc_id", "component": "component_id"})
