"""Canonical schemas and fixed metadata tables."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _B, _TS = T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()

#: one reading of one battery at one instant; current is positive for discharge
SAMPLES = T.StructType(
    [
        T.StructField("device", _S, False),
        T.StructField("ts", _TS, False),
        T.StructField("ingest_ts", _TS),
        *[
            T.StructField(c, _D)
            for c in (
                "voltage current power charge capacity aged_capacity soc soh total_charge_throughput "
                "total_charge_net num_cycles balance_current mos_temperature uptime runtime"
            ).split()
        ],
        T.StructField("soc_is_int", _B),
        T.StructField("temperatures", T.ArrayType(_D)),
        T.StructField("switches", T.MapType(_S, _B)),
        T.StructField("problem", _B),
        T.StructField("problem_code", T.LongType()),
        T.StructField("battery_charging", _B),
        T.StructField("battery_mode", _S),
        T.StructField("cell_mv", T.ArrayType(T.IntegerType())),
    ]
)

CELLS = T.StructType(
    [
        T.StructField("device", _S, False),
        T.StructField("ts", _TS, False),
        T.StructField("cell_index", T.IntegerType(), False),
        T.StructField("mv", T.IntegerType()),
    ]
)

#: one entry of the monitor's options document
DEVICE_OPTIONS = T.StructType(
    [
        T.StructField("alias", _S),
        T.StructField("address", _S),
        T.StructField("type", _S),
        T.StructField("debug", _B),
        T.StructField("pin", _S),
        T.StructField("adapter", _S),
        T.StructField("algorithm", _S),
        T.StructField("current_calibration", _D),
        T.StructField("note", _S),
    ]
)

#: fixed values: entity topic -> (field, unit, device class, state class, precision, significant digits)
ENTITIES = {
    "soc/total_voltage": ("voltage", "V", "voltage", "measurement", 2, 4),
    "soc/current": ("current", "A", "current", "measurement", 2, 4),
    "soc/balance_current": ("balance_current", "A", "current", "measurement", 2, 4),
    "soc/soc_percent": ("soc", "%", "battery", "measurement", 2, 4),
    "soc/power": ("power", "W", "power", "measurement", 1, 4),
    "soc/capacity": ("capacity", "Ah", None, None, None, 5),
    "soc/aged_capacity": ("aged_capacity", "Ah", None, None, 2, 5),
    "soc/soh": ("soh", "%", None, "measurement", 1, 5),
    "soc/cycle_capacity": ("total_charge_throughput", "Ah", None, None, None, 5),
    "soc/num_cycles": ("num_cycles", "N", None, "measurement", None, 5),
    "mosfet_status/capacity_ah": ("charge", "Ah", None, None, None, 5),
    "mosfet_status/temperature": ("mos_temperature", "°C", "temperature", "measurement", None, 5),
    "bms/uptime": ("uptime", "s", "duration", "measurement", 0, 5),
    "bms/runtime": ("runtime", "s", "duration", "measurement", 0, 5),
    "soc/total_charge_net": ("total_charge_net", "Ah", None, "total_increasing", None, 5),
    "meter/sample_count": ("num_samples", "N", None, "measurement", None, 5),
}

#: fixed values: meter entity -> (unit, device class, state class, precision)
METER_ENTITIES = {
    "meter/total_energy": ("kWh", "energy", None, 2),
    "meter/total_energy_charge": ("kWh", "energy", "total_increasing", 2),
    "meter/total_energy_discharge": ("kWh", "energy", "total_increasing", 2),
    "meter/total_charge": ("Ah", None, None, 2),
    "meter/total_cycles": ("N", None, None, 2),
}

#: fixed values: names that meters are announced under
METER_NAMES = {
    "meter/total_energy": "total energy netted",
    "meter/total_energy_charge": "total energy input",
    "meter/total_energy_discharge": "total energy output",
    "meter/total_charge": "total charge netted",
    "meter/total_cycles": "total cycle count",
}

#: fixed values: scaled-integer columns of the compact export, field -> scale
INT_SCALE = {
    "voltage": 1000,
    "current": 1000,
    "balance_current": 1000,
    "soc": 100,
    "soh": 100,
    "capacity": 100,
    "aged_capacity": 100,
    "cycle_capacity": 100,
    "mos_temperature": 100,
    **{f"temperatures_{i}": 100 for i in range(8)},
}
#: fixed values: the other columns of the compact export
LONG_FIELDS = ("problem_code",)
BOOL_FIELDS = (
    "switches_charge",
    "switches_discharge",
    "switches_balance",
    "switches_float_charge",
    "switches_status_normal",
    "switches_status_charging",
    "switches_status_discharging",
    "switches_status_protection",
    "switches_status_overvolt_protection",
    "switches_status_undervolt_protection",
    "switches_status_overtemp",
    "switches_status_undertemp",
    "switches_status_short",
)
FLOAT_FIELDS = (
    "power",
    "_power",
    "charge",
    "total_charge_throughput",
    "num_cycles",
    "num_samples",
    "battery_charging",
    "problem",
    "uptime",
    "runtime",
)
MAX_CELLS = 32
