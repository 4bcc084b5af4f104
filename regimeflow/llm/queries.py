"""Queries of this subpackage, and their SQL where SQL can state them."""

from . import exponents, kmeans, knn, mixing, packing, pii, segments

MODULES = (kmeans, exponents, knn, segments, packing, mixing, pii)

QUERIES = {name: f for m in MODULES for name, f in vars(m).items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
SQL = {name: text for m in MODULES for name in QUERIES if (text := vars(m).get(f"{name.upper()}_SQL"))}
