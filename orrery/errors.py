"""Failures: schema errors found while a plan is built, and broken call contracts."""


class EngineError(Exception):
    """Any error of this engine about data or schema."""


class ColumnNotFoundError(EngineError): ...


class ColumnTypeError(EngineError): ...


class RowCountError(EngineError): ...


class InvalidNameError(EngineError): ...


class ColumnConflictError(EngineError): ...


class SchemaMismatchError(EngineError): ...


class UnsupportedError(EngineError): ...


class InvalidRecordError(EngineError): ...


class InvalidRowError(EngineError): ...


class LengthMismatchError(EngineError): ...


class ContractError(ValueError):
    """An argument that no data could make right: bounds, empty callbacks, bad quantiles."""


__all__ = [n for n, v in list(globals().items()) if isinstance(v, type) and n.endswith("Error")]
