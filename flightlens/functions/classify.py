"""Label maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Fleet role -> report role.
ROLE_LABELS = {
    "AEW/SAR/Patrol": "Non Commercial",
    "Combi": "Combi",
    "Conv Pax/Freight": "Combi",
    "Corporate/Government": "Non Commercial",
    "Freighter": "Cargo",
    "Medical Evacuation": "Non Commercial",
    "Military Freighter": "Non Commercial",
    "Military Tanker": "Non Commercial",
    "Military/Passenger/Trainer/Utility": "Non Commercial",
    "Passenger": "Passenger",
    "R & D": "Non Commercial",
    "Utility": "Non Commercial",
}

# Aircraft type -> manufacturer, overriding the fleet sheet.
MANUFACTURERS = {
    "B350": "Beech Aircraft Corporation",
    "B77W": "Boeing",
    "BE20": "Beech Aircraft Corporation",
    "C550": "Cessna Aerospace",
    "F2TH": "Dassault Aviation",
    "RJ85": "Avro",
}


def label(value: Column, labels: dict[str, str]) -> Column:
    """Look a value up in a constant map; null if it is not there."""
    pairs = chain.from_iterable(labels.items())
    return F.try_element_at(F.create_map(*[F.lit(text) for text in pairs]), value)


def role_label(role: Column, labels: dict[str, str] = ROLE_LABELS) -> Column:
    """Report role; null for a null or unknown fleet role."""
    return label(role, labels)


def manufacturer(type_code: Column, joined: Column, overrides: dict[str, str] = MANUFACTURERS) -> Column:
    return F.coalesce(label(type_code, overrides), joined)
