"""What can be wrong with a plan."""


class PlanError(Exception):
    """Base of all errors found while a plan is read or compiled."""


class MissingParameter(PlanError):
    pass


class InvalidParameter(PlanError):
    pass


class IllegalSchema(PlanError):
    pass


class UnknownComparison(PlanError):
    pass


class UnknownHash(PlanError):
    pass


class NotYetImplemented(PlanError):
    pass
