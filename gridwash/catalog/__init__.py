"""Every operator as a query over the shared tables, with the SQL that checks it."""

from gridwash.catalog import (cells, duplicates, files, ordered, profiles, recipes, relations, reports, sqlsteps,
                              streams, texts)
from gridwash.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cells", "duplicates", "files", "ordered", "profiles", "recipes", "relations",
           "reports", "sqlsteps", "streams", "texts"]
