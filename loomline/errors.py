"""Errors that a user of a pipeline sees; each message says all there is to say."""


class ConfigError(ValueError):
    """The pipeline file is wrong."""


class PipelineError(RuntimeError):
    """The pipeline can't be built or run."""


class StageError(PipelineError):
    """A failure with the stage it happened in; an error that has a stage keeps it."""

    def __init__(self, stage: str, cause: BaseException | str, assembly: bool = False):
        message = cause if isinstance(cause, str) else str(cause).strip() or type(cause).__name__
        super().__init__(message if any(message.startswith(f"{s} stage failed:") for s in STAGES) else f"{stage} stage failed: {message}")
        self.stage = stage
        #: Whether the pipeline couldn't be put together; trying again would not help.
        self.assembly = assembly


STAGES = ("Source", "Transform", "Sink", "Checkpoint")
