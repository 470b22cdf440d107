"""All queries of the core by name."""

from __future__ import annotations

from shalework.plans import general, reports, survey, xml_queries

QUERIES = {**general.QUERIES, **survey.QUERIES, **reports.QUERIES, **xml_queries.QUERIES}
SQL = {**general.SQL, **survey.SQL, **xml_queries.SQL}
