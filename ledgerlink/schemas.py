"""Schemas of the layers; nothing is inferred."""

EMAIL_RECORDS = (
    "source_file string, body_text_file string, attachment_files array<string>, message_uid string, message_id string, sent_at string, `from` string, `to` string, "
    "subject string, bank_key string, bank_name string, candidate_transactions array<struct<raw_line:string,amounts:array<string>,direction:string,account_tail:string,transaction_time:string>>, warnings array<string>"
)
ORDER_FILE = "platform string, source_image string, warnings array<string>, orders string"
ORDER = (
    "merchant string, status string, title string, spec string, quantity string, paid_amount string, original_amount string, shipping_fee string, order_time string, "
    "order_id string, logistics string, actions string, is_partial boolean, confidence double, notes string"
)
BANK = (
    "bank_key string, bank_name string, account_tail string, transaction_time string, direction string, amount string, merchant string, counterparty string, summary string, "
    "balance string, channel string, transaction_reference string, source_file string, row int, confidence double"
)
MANIFEST = "path string, filename string, extension string, kind string, bank_key string, message_uid string, message_id string, status string, reason string, output_files array<string>"
