"""Named queries by subject."""

from navloom.plans import disclosure_pages, fund_view, funds, imports, ledger, lists, lookthrough, lots, reference, results, returns, sheets, statement, text

CATALOGUES = [m.C for m in (lookthrough, funds, fund_view, ledger, lots, returns, imports, text, statement, reference, sheets, disclosure_pages, lists, results)]
