"""Company records: companies, owners, auditors, other registers, filings and document contexts.

Each part takes DataFrames (wide or long) and returns DataFrames; names are
matched by ``operators.lookup``, so an ambiguous name gives no rows.
"""
