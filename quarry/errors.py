"""What can go wrong, by kind."""


class QuarryError(Exception):
    """Any error of the engine."""


class ParseError(QuarryError):
    """The text isn't SQL of the dialect."""


class SchemaError(QuarryError):
    """A table or column is defined twice, or not as needed."""


class TypeMismatch(QuarryError):
    """A value can't take the type asked for."""


class ConstraintError(QuarryError):
    """NOT NULL, UNIQUE or PRIMARY KEY would be violated."""


class StorageError(QuarryError):
    """The table store can't be read or written."""


class NotFound(QuarryError):
    """No such table, column or function."""


class Ambiguous(QuarryError):
    """A column name fits several tables."""


class Unsupported(QuarryError):
    """The dialect has it, this engine doesn't."""
