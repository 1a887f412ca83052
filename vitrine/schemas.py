"""Schemas of the raw inputs. Unknown keys drop, missing keys are NULL; nothing is inferred."""

_INSTRUCTION = ("STRUCT<program: STRING, programId: STRING, accounts: ARRAY<STRING>, data: STRING, "
                "parsed: STRUCT<type: STRING, info: STRUCT<source: STRING, destination: STRING, account: STRING, "
                "wallet: STRING, owner: STRING>>>")
_BALANCE = ("STRUCT<accountIndex: INT, mint: STRING, owner: STRING, "
            "uiTokenAmount: STRUCT<amount: STRING, decimals: INT>>")
_MESSAGE = f"STRUCT<accountKeys: ARRAY<STRING>, instructions: ARRAY<{_INSTRUCTION}>>"
_META = (f"STRUCT<err: STRING, fee: BIGINT, preBalances: ARRAY<DECIMAL(20,0)>, postBalances: ARRAY<DECIMAL(20,0)>, "
         f"preTokenBalances: ARRAY<{_BALANCE}>, postTokenBalances: ARRAY<{_BALANCE}>, "
         f"innerInstructions: ARRAY<STRUCT<index: INT, instructions: ARRAY<{_INSTRUCTION}>>>, "
         "loadedAddresses: STRUCT<writable: ARRAY<STRING>, readonly: ARRAY<STRING>>>")

# Both nestings: {transaction: {message}, meta} and {transaction: {transaction: {message}, meta}}.
TRANSACTION = (f"slot BIGINT, blockTime BIGINT, meta {_META}, transaction STRUCT<signatures: ARRAY<STRING>, "
               f"blockTime: BIGINT, message: {_MESSAGE}, meta: {_META}, transaction: STRUCT<message: {_MESSAGE}>>")

_ATTRIBUTES = "ARRAY<STRUCT<trait_type: STRING, value: STRING>>"
SNAPSHOT = ("id STRING, interface STRING, burnt BOOLEAN, ownership STRUCT<owner: STRING>, "
            "content STRUCT<json_uri: STRING, files: ARRAY<STRUCT<uri: STRING, mime: STRING>>, "
            f"links: STRUCT<image: STRING>, metadata: STRUCT<name: STRING, symbol: STRING, attributes: {_ATTRIBUTES}>>")
DOCUMENT = (f"name STRING, symbol STRING, image STRING, animation_url STRING, attributes {_ATTRIBUTES}, "
            "properties STRUCT<files: ARRAY<STRUCT<uri: STRING>>>")
DELIVERY = f"signature STRING, transaction STRUCT<signatures: ARRAY<STRING>>, slot BIGINT, blockTime BIGINT, timestamp BIGINT, transactionError STRING, meta STRUCT<err: STRING>"
