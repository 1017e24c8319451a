from orweave.sources.catalog import Catalog
from orweave.sources.imports import read_csv
from orweave.sources.synthetic import write_synthetic

__all__ = ["Catalog", "read_csv", "write_synthetic"]
