"""Failures with a fixed code; messages never carry row values."""


class EngineError(ValueError):
    """A rule was broken; ``code`` names it."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code

    def __repr__(self) -> str:
        return f"EngineError({self.code})"
