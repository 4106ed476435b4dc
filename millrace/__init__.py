"""millrace - a Spark-native record store and analytics engine."""

from .database import Database
from .mapping import column, record
from .plans.predicate import Condition, Filter
from .plans.schema import Index, Relation, TableDiff, TableSchema, Unique

__all__ = ["Condition", "Database", "Filter", "Index", "Relation", "TableDiff", "TableSchema", "Unique", "column", "record"]
