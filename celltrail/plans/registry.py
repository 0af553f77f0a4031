"""All registered queries and their SQL."""

from . import catalogue, graphs, learn, more, tables

QUERIES = catalogue.QUERIES | more.QUERIES | tables.QUERIES | graphs.QUERIES | learn.QUERIES
SQL = catalogue.SQL | more.SQL | tables.SQL | graphs.SQL | learn.SQL
