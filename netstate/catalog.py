"""Table catalog: schema, keys, display order, kind and version of every table.

Nothing is inferred when data is read: readers and writers take the Spark
schema from here.  ``kind`` is ``record`` (change log, one row per state
change), ``counters`` (every sample is kept) or ``derived`` (computed from
other tables, never stored).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The stored data model (column names and types, key order,
# display order, versions).  Data written by existing collectors uses these.
# ---------------------------------------------------------------------------

COMMON_DDL = (
    "sqvers STRING, namespace STRING, hostname STRING, deviceSession BIGINT, "
    "timestamp BIGINT, active BOOLEAN"
)

_LOAD_DDL = (
    "procName STRING, pid BIGINT, user STRING, state STRING, priority BIGINT, nice BIGINT, "
    "percentCPU FLOAT, percentMem FLOAT, minLoadAvg FLOAT, fiveMinLoadAvg FLOAT, "
    "fifteenMinLoadAvg FLOAT, totalMem BIGINT, freeMem BIGINT, usedMem BIGINT, cacheMem BIGINT, "
    "virtualMem BIGINT, residentMem BIGINT, sharedMem BIGINT, runningTime STRING"
)

_DDL = {
    "device": (
        "architecture STRING, memory INT, reason STRING, status STRING, address STRING, "
        "model STRING, vendor STRING, version STRING, bootupTimestamp DOUBLE, os STRING, "
        "serialNumber STRING"
    ),
    "interfaces": (
        "ifname STRING, ifindex BIGINT, reason STRING, routeDistinguisher STRING, macaddr STRING, "
        "interfaceMac STRING, type STRING, description STRING, numChanges BIGINT, speed BIGINT, "
        "vlan INT, innerVlan INT, vlanName STRING, vni INT, ipAddressList ARRAY<STRING>, "
        "ip6AddressList ARRAY<STRING>, srcVtepIp STRING, state STRING, adminState STRING, "
        "master STRING, statusChangeTimestamp DOUBLE, lacpBypass BOOLEAN, mtu BIGINT"
    ),
    "routes": (
        "vrf STRING, prefix STRING, nexthopIps ARRAY<STRING>, oifs ARRAY<STRING>, "
        "weights ARRAY<BIGINT>, protocol STRING, source STRING, action STRING, preference BIGINT, "
        "metric BIGINT, ipvers BIGINT, asPathList ARRAY<STRING>, routeTag STRING, "
        "validState STRING, hardwareProgrammed STRING, statusChangeTimestamp BIGINT"
    ),
    "arpnd": "ipAddress STRING, oif STRING, macaddr STRING, state STRING, remote BOOLEAN",
    "macs": (
        "mackey STRING, macaddr STRING, vlan BIGINT, bd STRING, oif STRING, "
        "remoteVtepIp STRING, flags STRING, protocol STRING"
    ),
    "vlan": "vlanName STRING, vlan BIGINT, interfaces ARRAY<STRING>, state STRING",
    "lldp": (
        "ifname STRING, peerHostname STRING, peerIfname STRING, peerMacaddr STRING, "
        "peerIfindex BIGINT, subtype STRING, mgmtIP STRING, description STRING"
    ),
    "mlag": (
        "systemId STRING, domainId STRING, role STRING, peerRole STRING, state STRING, "
        "peerLink STRING, peerLinkStatus STRING, peerAddress STRING, peerMacAddress STRING, "
        "vtepIP STRING, usesLinkLocal BOOLEAN, configSanity STRING, portsErrDisabled STRING, "
        "backupIP STRING, backupReason STRING, backupActive BOOLEAN, "
        "mlagDualPortsList ARRAY<STRING>, mlagSinglePortsList ARRAY<STRING>, "
        "mlagErrorPortsList ARRAY<STRING>, mlagDualPortsCnt BIGINT, mlagSinglePortsCnt BIGINT, "
        "mlagErrorPortsCnt BIGINT"
    ),
    "bgp": (
        "vrf STRING, peer STRING, origPeer STRING, afi STRING, safi STRING, asn BIGINT, "
        "peerAsn BIGINT, state STRING, reason STRING, notificnReason STRING, peerIP STRING, "
        "updateSource STRING, peerHostname STRING, ifname STRING, routerId STRING, "
        "peerRouterId STRING, pfxRx BIGINT, pfxTx BIGINT, pfxBestRx BIGINT, "
        "pfxWithdrawnRx BIGINT, pfxSuppressRx BIGINT, pfxMaxRx BIGINT, pfxWarnPercent BIGINT, "
        "updatesRx BIGINT, updatesTx BIGINT, numChanges BIGINT, estdTime DOUBLE, "
        "lastDownTime BIGINT, afisAdvOnly ARRAY<STRING>, afisRcvOnly ARRAY<STRING>, "
        "communityTypes ARRAY<STRING>, rrclient STRING, bfdStatus STRING, hopsMax BIGINT, "
        "advertiseAllVnis BOOLEAN, egressRmap STRING, ingressRmap STRING, softReconfig BOOLEAN, "
        "defOriginate BOOLEAN, nhUnchanged BOOLEAN, nhSelf BOOLEAN, extnhAdvertised BOOLEAN, "
        "extnhReceived BOOLEAN, extnhEnabled BOOLEAN, keepaliveTime BIGINT, holdTime BIGINT, "
        "mrai BIGINT"
    ),
    "ospfIf": (
        "vrf STRING, ifname STRING, area STRING, areaStub BOOLEAN, state STRING, "
        "passive BOOLEAN, helloTime BIGINT, deadTime BIGINT, retxTime BIGINT, "
        "networkType STRING, ipAddress STRING, maskLen BIGINT, isUnnumbered BOOLEAN, "
        "routerId STRING, cost BIGINT, nbrCount BIGINT, instance STRING, stubType STRING, "
        "authType STRING, noSummary BOOLEAN, isBackbone BOOLEAN"
    ),
    "ospfNbr": (
        "vrf STRING, ifname STRING, peerIP STRING, state STRING, peerRouterId STRING, "
        "numChanges BIGINT, lastChangeTime BIGINT, lastUpTime BIGINT, lastDownTime BIGINT, "
        "nbrPrio BIGINT, area STRING, areaStub BOOLEAN, ipAddress STRING, bfdStatus STRING, "
        "lsaRetxCnt BIGINT, instance STRING, reason STRING"
    ),
    "evpnVni": (
        "vni BIGINT, type STRING, vlan BIGINT, vrf STRING, ifname STRING, state STRING, "
        "priVtepIp STRING, secVtepIp STRING, remoteVtepList ARRAY<STRING>, "
        "l2VniList ARRAY<BIGINT>, mcastGroup STRING, replicationType STRING, numMacs BIGINT, "
        "numArpNd BIGINT, routerMac STRING, advGateway BOOLEAN, vniFilter STRING"
    ),
    "inventory": (
        "name STRING, type STRING, partType STRING, model STRING, serial STRING, "
        "partNum STRING, vendor STRING, version STRING, status STRING"
    ),
    "devconfig": "config STRING",
    "fs": (
        "mountPoint STRING, device STRING, fstype STRING, totalSize STRING, usedSize STRING, "
        "availSize STRING, usedPercent BIGINT"
    ),
    "ifCounters": (
        "ifname STRING, txBytes BIGINT, rxBytes BIGINT, txPackets BIGINT, rxPackets BIGINT, "
        "txErrs BIGINT, rxErrs BIGINT, txDrops BIGINT, rxDrops BIGINT, txFifo BIGINT, "
        "rxFifo BIGINT, txCollisions BIGINT, txCarrier BIGINT, rxMcst BIGINT, rxFrame BIGINT, "
        "txCompressed BIGINT, rxCompressed BIGINT"
    ),
    "topcpu": _LOAD_DDL,
    "topmem": _LOAD_DDL,
    "time": (
        "ntpSync STRING, ntpEnabled STRING, ntpServer STRING, stratum BIGINT, offset STRING, "
        "timezone STRING"
    ),
    "sqPoller": (
        "service STRING, status BIGINT, gatherTime ARRAY<FLOAT>, totalTime ARRAY<FLOAT>, "
        "svcQsize ARRAY<FLOAT>, wrQsize ARRAY<FLOAT>, nodeQsize ARRAY<FLOAT>, "
        "rxBytes ARRAY<DOUBLE>, pollExcdPeriodCount BIGINT, nodesPolledCnt BIGINT, "
        "nodesFailedCnt BIGINT, version STRING"
    ),
    "sqCoalescer": (
        "service STRING, period STRING, execTime BIGINT, fileCount BIGINT, recCount BIGINT, "
        "version STRING"
    ),
}

_VERSION = {
    "device": "4.0", "interfaces": "4.0", "routes": "3.0", "arpnd": "2.0", "macs": "2.0",
    "vlan": "3.0", "lldp": "2.0", "mlag": "2.0", "bgp": "3.0", "ospfIf": "2.0",
    "ospfNbr": "3.0", "evpnVni": "2.0", "inventory": "3.0", "devconfig": "2.0", "fs": "2.0",
    "ifCounters": "2.0", "topcpu": "2.0", "topmem": "2.0", "time": "3.0", "sqPoller": "3.0",
    "sqCoalescer": "1.0", "address": "1.0", "ospf": "1.0", "namespace": "2.0", "path": "1.0",
    "topology": "1.0", "tables": "2.0", "network": "",
}

# Keys after (namespace, hostname).
_KEYS = {
    "interfaces": ["ifname"], "address": ["ifname"], "routes": ["vrf", "prefix"],
    "arpnd": ["ipAddress", "oif"], "macs": ["mackey", "macaddr"], "vlan": ["vlanName"],
    "lldp": ["ifname"], "bgp": ["vrf", "peer", "afi", "safi"], "ospfIf": ["vrf", "ifname"],
    "ospfNbr": ["vrf", "ifname", "peerIP"], "ospf": ["vrf", "ifname"], "evpnVni": ["vni"],
    "inventory": ["name"], "fs": ["mountPoint"], "ifCounters": ["ifname"],
    "topcpu": ["procName", "pid"], "topmem": ["procName", "pid"], "sqPoller": ["service"],
}

_DISPLAY = {
    "device": "version model vendor serialNumber status address bootupTimestamp timestamp",
    "interfaces": (
        "ifname state adminState type mtu vlan master ipAddressList ip6AddressList timestamp"
    ),
    "address": "ifname ipAddressList macaddr ip6AddressList state vrf timestamp",
    "routes": (
        "vrf prefix nexthopIps oifs protocol source preference ipvers action timestamp"
    ),
    "arpnd": "ipAddress oif macaddr state remote timestamp",
    "macs": "vlan macaddr oif remoteVtepIp bd flags timestamp",
    "vlan": "vlanName state interfaces vlan timestamp",
    "lldp": "ifname peerHostname peerIfname description mgmtIP timestamp",
    "mlag": (
        "systemId state peerAddress role peerLink mlagDualPortsCnt mlagSinglePortsCnt "
        "mlagErrorPortsCnt timestamp"
    ),
    "bgp": (
        "vrf peer peerHostname state afi safi asn peerAsn pfxRx pfxTx numChanges estdTime timestamp"
    ),
    "ospfIf": "vrf ifname area state passive nbrCount",
    "ospfNbr": "vrf ifname state peerIP ipAddress area lastChangeTime numChanges",
    "ospf": (
        "vrf ifname peerHostname area ifState nbrCount adjState peerIP numChanges "
        "lastChangeTime timestamp"
    ),
    "evpnVni": (
        "vni type vlan state mcastGroup remoteVtepCnt priVtepIp secVtepIp timestamp"
    ),
    "inventory": "name model status vendor type version partType timestamp",
    "devconfig": "config timestamp",
    "fs": "mountPoint totalSize usedSize usedPercent device timestamp",
    "ifCounters": "ifname",
    "topcpu": "procName pid percentCPU minLoadAvg percentMem residentMem",
    "topmem": "procName pid percentCPU minLoadAvg percentMem residentMem",
    "time": "ntpSync ntpServer stratum offset",
    "sqPoller": (
        "service statusStr gatherTime totalTime svcQsize wrQsize nodeQsize rxBytes "
        "pollExcdPeriodCount timestamp"
    ),
}

_DERIVED_TABLE_DISPLAY = {
    "namespace": (
        "namespace deviceCnt serviceCnt errSvcCnt hasOspf hasBgp hasVxlan hasMlag lastUpdate"
    ),
    "network": "namespace hostname vrf ipAddress vlan macaddr ifname bondMembers type l2miss",
    "path": (
        "pathid hopCount namespace hostname iif oif vrf isL2 overlay mtuMatch inMtu outMtu "
        "protocol ipLookup vtepLookup macLookup nexthopIp hopError timestamp"
    ),
    "topology": (
        "namespace hostname ifname peerHostname vrf asn peerAsn area arpnd arpndBidir bgp "
        "lldp ospf polled"
    ),
    "tables": "table firstTime lastTime intervals allRows namespaceCnt deviceCnt",
}

# Columns computed when read, with the columns they are computed from.
_COMPUTED = {
    "device": {"uptime": ["bootupTimestamp", "timestamp"]},
    "interfaces": {
        "portmode": ["adminState", "type", "ipAddressList", "ip6AddressList"],
        "vlanList": ["portmode"],
    },
    "address": {"vrf": ["master"], "ipAddress": ["ipAddressList", "ip6AddressList"]},
    "routes": {"prefixlen": ["prefix"], "numNexthops": ["oifs", "nexthopIps"]},
    "macs": {"moveCount": ["mackey", "macaddr", "oif", "remoteVtepIp"]},
    "bgp": {"asndot": ["asn"], "peerAsndot": ["peerAsn"], "afiSafi": ["afi", "safi"]},
    "evpnVni": {"remoteVtepCnt": ["remoteVtepList"]},
    "sqPoller": {"statusStr": ["status"]},
    "ospf": {
        "peerHostname": ["vrf", "ifname", "peerIP", "ipAddress"],
        "peerIfname": ["vrf", "ifname", "peerIP", "ipAddress", "adjState"],
    },
}

# Columns not shown for '*'.
HIDDEN_COLUMNS = ["sqvers", "deviceSession", "origPeer", "mackey"]

COUNTER_TABLES = ["ifCounters", "topcpu", "topmem", "sqPoller", "sqCoalescer"]
DERIVED_TABLES = ["address", "ospf", "namespace", "network", "path", "topology", "tables"]
PHYSICAL_TABLE = {"address": "interfaces"}

# Column whose distinct values `unique` reports when none is named.
UNIQUE_DEFAULT = {"routes": "prefix", "device": "hostname", "macs": "macaddr"}

# Kernel's unreachable placeholder routes carry this metric and are never shown.
KERNEL_UNREACHABLE_METRIC = 4278198272

# Fields that never count as a change between two captures of a table.
CHANGE_IGNORED_FIELDS = ["timestamp", "sqvers", "deviceSession"]
CHANGE_IGNORED_PER_TABLE = {
    "bgp": ["lastDownTime", "estdTime"],
    "device": ["bootupTimestamp"],
    "fs": ["usedSize", "availSize"],
    "ospfNbr": ["lastChangeTime", "lastUpTime", "lastDownTime"],
    "routes": ["statusChangeTimestamp"],
}


@dataclass(frozen=True)
class TableSpec:
    name: str
    version: str
    kind: str
    schema: T.StructType
    keys: list[str]
    display: list[str]
    computed: dict[str, list[str]] = field(default_factory=dict)
    physical: str = ""

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def type_of(self, column: str) -> T.DataType | None:
        return self.schema[column].dataType if column in self.columns else None


class UnknownTableError(KeyError):
    """Raised when a table is not in the catalog."""


class UnknownColumnError(ValueError):
    """Raised when a column is neither stored nor computed for a table."""


@lru_cache(maxsize=None)
def table_spec(name: str) -> TableSpec:
    if name not in _VERSION:
        raise UnknownTableError(name)
    kind = (
        "derived" if name in DERIVED_TABLES
        else "counters" if name in COUNTER_TABLES else "record"
    )
    stored = PHYSICAL_TABLE.get(name, name)
    if stored in _DDL:
        common = COMMON_DDL
        if stored == "sqPoller":
            common = common.replace("deviceSession BIGINT, ", "")
        if stored == "sqCoalescer":
            common = common.replace("hostname STRING, deviceSession BIGINT, ", "")
        schema = T.StructType.fromDDL(f"{_DDL[stored]}, {common}")
    else:
        schema = T.StructType([])
    if name == "sqCoalescer":
        keys = ["namespace", "service", "period"]
        display = keys + ["execTime", "fileCount", "recCount"]
    elif name in _DERIVED_TABLE_DISPLAY:
        display = _DERIVED_TABLE_DISPLAY[name].split()
        keys = ["namespace"] if name == "namespace" else []
    else:
        keys = ["namespace", "hostname"] + _KEYS.get(name, [])
        display = ["namespace", "hostname"] + _DISPLAY[name].split()
    return TableSpec(
        name=name, version=_VERSION[name], kind=kind, schema=schema, keys=keys,
        display=display, computed=_COMPUTED.get(name, {}),
        physical="" if kind == "derived" and name not in PHYSICAL_TABLE else stored,
    )


def table_names(stored_only: bool = False) -> list[str]:
    return sorted(_DDL if stored_only else _VERSION)


# Default of each type, used where a field is missing from a capture.
def default_value(dtype: T.DataType):
    if isinstance(dtype, T.StringType):
        return ""
    if isinstance(dtype, T.BooleanType):
        return False
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return 0.0
    if isinstance(dtype, T.ArrayType):
        return []
    return 0
