"""Checked job parameters."""

from __future__ import annotations

from dataclasses import dataclass

from runcourier.schema import CHAT_FORMATS, EMAIL_PROVIDERS, RUN_ORDERS, one_of


def _flag(value: str | bool) -> bool:
    if isinstance(value, bool):
        return value
    return one_of(value, ("true", "false"), "flag") == "true"


@dataclass(frozen=True)
class ChatParams:
    """Parameters of the chat job. A blank run id means the latest run."""

    run_id: str | None = ""
    webhook_url: str = ""
    webhook_format: str = "slack"
    run_order: str = "lexical"

    def __post_init__(self):
        one_of(self.webhook_format, CHAT_FORMATS, "webhook_format")
        one_of(self.run_order, RUN_ORDERS, "run_order")


@dataclass(frozen=True)
class EmailParams:
    """Parameters of the email job. Nothing leaves a dry run but a preview."""

    run_id: str | None = ""
    provider: str = "resend"
    sender: str = ""
    recipients: str = ""
    subject: str = ""
    dry_run: str | bool = "true"
    run_order: str = "lexical"

    def __post_init__(self):
        one_of(self.provider, EMAIL_PROVIDERS, "provider")
        one_of(self.run_order, RUN_ORDERS, "run_order")
        object.__setattr__(self, "dry_run", _flag(self.dry_run))
