"""Error codes of the engine and their exceptions."""

# Code -> HTTP status.
STATUS = {
    "ENGINE_ERROR": 400, "PARSE_ERROR": 400, "PARSE_UNSUPPORTED_ELEMENT": 400, "PAYLOAD_TOO_LARGE": 413,
    "VOCAB_MISMATCH": 400, "VERSION_REQUIRED": 400, "INVALID_REQUEST": 400, "JOB_NOT_FOUND": 404,
}


class EngineError(Exception):
    """An error with a code of STATUS."""

    def __init__(self, code: str, message: str, **detail):
        super().__init__(message)
        self.code, self.message, self.detail, self.status = code, message, detail, STATUS[code]

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message} | ({"detail": self.detail} if self.detail else {})
