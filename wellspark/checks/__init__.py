"""The library's operators over the given TPC-H-like tables, each with its equivalent SQL."""

from wellspark.checks import documents, operators, projects, values

# Name -> (query, SQL or None).
REGISTRY = {
    **documents.QUERIES,
    **operators.QUERIES,
    **values.QUERIES,
    **projects.QUERIES,
}
