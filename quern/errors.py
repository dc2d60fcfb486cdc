"""What can go wrong with a release, for its readers and for its publisher."""


class ReleaseError(Exception):
    """Base of all errors here."""


class InvalidPath(ReleaseError):
    pass


class InvalidFormat(ReleaseError):
    pass


class AssetNotFound(ReleaseError):
    pass


class SegmentUnavailable(ReleaseError):
    pass


class ProjectMismatch(ReleaseError):
    pass


class ReleaseRollback(ReleaseError):
    def __init__(self, required: int, found: int) -> None:
        super().__init__(f"release {found} is older than the required {required}")
        self.required, self.found = required, found


class IntegrityError(ReleaseError):
    pass


class OutOfRange(ReleaseError):
    pass


class InvalidInput(ReleaseError):
    pass


class StalePlan(ReleaseError):
    pass


class BuildLocked(ReleaseError):
    pass
