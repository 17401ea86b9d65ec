"""Errors with a stable code."""

from __future__ import annotations

#: Codes and their default messages (fixed values).
MESSAGES = {
    "INVALID_REQUEST": "请求参数不正确",
    "UPLOAD_TOO_LARGE": "上传文件不能超过 20MB",
    "CONFIG_READ_FAILED": "配置文件读取失败",
    "CONFIG_INVALID": "配置文件内容不合法",
    "CONFIG_NOT_FOUND": "遥控器配置不存在",
    "CSV_READ_FAILED": "CSV 文件读取失败",
    "PROTOCOL_PARSE_FAILED": "协议解析失败",
    "EXCEL_GENERATION_FAILED": "Excel 生成失败",
    "INTERNAL_ERROR": "服务处理失败，请查看运行窗口或日志",
}
#: Statuses of the codes for a caller that speaks HTTP; others are 422.
STATUSES = {"INVALID_REQUEST": 400, "UPLOAD_TOO_LARGE": 413, "CONFIG_NOT_FOUND": 404, "EXCEL_GENERATION_FAILED": 500, "INTERNAL_ERROR": 500}


class CaptureError(Exception):
    """An error of the engine; ``code`` is one of MESSAGES."""

    def __init__(self, code: str, message: str | None = None):
        self.code, self.message = code, message or MESSAGES[code]
        super().__init__(f"{code}: {self.message}")

    @property
    def status(self) -> int:
        return STATUSES.get(self.code, 422)

    def body(self) -> dict[str, str]:
        return {"code": self.code, "message": self.message}
