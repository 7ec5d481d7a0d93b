"""What can go wrong: an unknown record, a bad request, a bad configuration, a failing provider, a lost race."""


class MemoryError_(Exception):
    """Base of the engine's errors."""


class NotFound(MemoryError_):
    pass


class Validation(MemoryError_):
    pass


class Config(MemoryError_):
    pass


class Provider(MemoryError_):
    pass


class Conflict(MemoryError_):
    """Another writer changed what a change builds on."""


class DimensionMismatch(Provider):
    def __init__(self, expected: int, found: int):
        super().__init__(f"vectors have {expected} numbers, this one {found}")
        self.expected, self.found = expected, found
