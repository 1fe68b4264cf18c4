"""A small routed network: spines, leaf pairs with MLAG, exits and servers.

T0..T2 are poll moments.  Faults are planted one per assertion.
"""

from netstate.catalog import default_value, table_spec

T0, T1, T2 = 1_700_000_000_000, 1_700_003_600_000, 1_700_007_200_000
NS = "dc1"
SPINES = ["spine01", "spine02"]
LEAVES = ["leaf01", "leaf02", "leaf03", "leaf04"]
SERVERS = {"server101": ("leaf01", "leaf02", 13), "server102": ("leaf01", "leaf02", 24),
           "server103": ("leaf03", "leaf04", 13), "server104": ("leaf03", "leaf04", 24)}


def frame(spark, table, records):
    spec = table_spec(table)
    out = []
    for r in records:
        row = []
        for f in spec.schema.fields:
            base = {"namespace": NS, "timestamp": T0, "active": True,
                    "sqvers": spec.version}.get(f.name, default_value(f.dataType))
            row.append(r.get(f.name, base))
        out.append(tuple(row))
    return spark.createDataFrame(out, spec.schema)


def mac(host, port=0):
    names = [*SPINES, *LEAVES, *SERVERS, "exit01"]
    return f"44:38:39:00:{names.index(host):02x}:{port:02x}"


def links():
    """(host, port, ip, peer, peer port, peer ip): leaf to spine /31 links."""
    out, n = [], 0
    for li, leaf in enumerate([*LEAVES, "exit01"]):
        for si, spine in enumerate(SPINES):
            out.append((leaf, f"swp{51 + si}", f"10.255.{n}.0/31",
                        spine, f"swp{1 + li}", f"10.255.{n}.1/31"))
            n += 1
    return out


def frames(spark):
    interfaces, lldp, routes, arp, macs, bgp, ospf_if, ospf_nbr = ([] for _ in range(8))
    loop = {h: f"10.0.0.{i + 11}" for i, h in enumerate([*SPINES, *LEAVES, "exit01"])}
    for h, ip in loop.items():
        interfaces.append(dict(hostname=h, ifname="lo", type="loopback", state="up",
                               adminState="up", mtu=65536, ipAddressList=[f"{ip}/32"],
                               ip6AddressList=[f"2001:db8::{ip.split('.')[-1]}/128"]))
        ospf_if.append(dict(hostname=h, vrf="default", ifname="lo", area="0.0.0.0", state="up",
                            passive=True, networkType="loopback", ipAddress=f"{ip}/32",
                            routerId=ip, helloTime=10, deadTime=40))
    asn = {h: 65020 for h in SPINES} | {h: 65011 + i for i, h in enumerate([*LEAVES, "exit01"])}
    for a, ap, aip, b, bp, bip in links():
        for h, p, ip, ph, pp, pip in ((a, ap, aip, b, bp, bip), (b, bp, bip, a, ap, aip)):
            port = int(p[3:])
            mtu = 1500 if (h, p) == ("leaf04", "swp52") else 9216
            interfaces.append(dict(
                hostname=h, ifname=p, type="ethernet", state="up", adminState="up", mtu=mtu,
                speed=40000 if (h, p) == ("leaf03", "swp52") else 100000, macaddr=mac(h, port),
                ipAddressList=[ip], numChanges=port % 3, ifindex=port))
            lldp.append(dict(hostname=h, ifname=p, peerHostname=ph, peerIfname=pp,
                             mgmtIP="10.1.1.1", subtype="interface name"))
            addr, paddr = ip.split("/")[0], pip.split("/")[0]
            arp.append(dict(hostname=h, ipAddress=paddr, oif=p, macaddr=mac(ph, int(pp[3:])),
                            state="reachable"))
            estd = {h, ph} != {"exit01", "spine02"}
            bgp.append(dict(
                hostname=h, vrf="default", peer=paddr, afi="ipv4" if estd else "",
                safi="unicast" if estd else "", asn=asn[h],
                peerAsn=asn[ph] + (7 if not estd and h == "exit01" else 0),
                state="Established" if estd else "NotEstd", peerIP=paddr, updateSource=addr,
                ifname=p, pfxRx=10, updatesRx=port, updatesTx=2 * port, estdTime=float(T0 - 5000),
                reason="" if estd else "Hold Timer", notificnReason="" if estd else "expired",
                afisAdvOnly=["l2vpn evpn"] if (h, p) == ("leaf01", "swp51") else []))
            ospf_if.append(dict(
                hostname=h, vrf="default", ifname=p, area="0.0.0.0", state="up",
                networkType="p2p", ipAddress=ip, routerId=loop[h] if h != "leaf04" else
                loop["leaf03"], helloTime=20 if (h, p) == ("leaf02", "swp52") else 10,
                deadTime=40))
            bad = {(a, ap), (b, bp)} & {("leaf02", "swp52")}
            if not bad:
                ospf_nbr.append(dict(
                    hostname=h, vrf="default", ifname=p, peerIP=paddr, state="full",
                    peerRouterId=loop[ph], numChanges=2, lastChangeTime=T0 - 60_000,
                    area="0.0.0.0", ipAddress=ip))
    # VLANs, servers behind leaf pairs.
    vlan_if = {13: "10.1.3", 24: "10.1.4"}
    vlans, members = [], {}
    for li, leaf in enumerate(LEAVES):
        for v, net in vlan_if.items():
            interfaces.append(dict(
                hostname=leaf, ifname=f"vlan{v}", type="vlan", state="up", adminState="up",
                mtu=9216, vlan=v, master="evpn-vrf", macaddr="44:39:39:ff:40:94",
                ipAddressList=[f"{net}.{li + 2}/24"]))
            members[(leaf, v)] = []
    for si, (srv, (l1, l2, v)) in enumerate(SERVERS.items()):
        ip = f"{vlan_if[v]}.{101 + si}"
        interfaces.append(dict(hostname=srv, ifname="bond0", type="bond", state="up",
                               adminState="up", mtu=9000, macaddr=mac(srv, 1),
                               ipAddressList=[f"{ip}/24"]))
        routes.append(dict(hostname=srv, vrf="default", prefix=f"{vlan_if[v]}.0/24",
                           nexthopIps=[], oifs=["bond0"], protocol="kernel", ipvers=4))
        gw = f"{vlan_if[v]}.{2 if l1 == 'leaf01' else 4}"
        routes.append(dict(hostname=srv, vrf="default", prefix="0.0.0.0/0", nexthopIps=[gw],
                           oifs=["bond0"], protocol="static", ipvers=4))
        arp.append(dict(hostname=srv, ipAddress=gw, oif="bond0", macaddr="44:39:39:ff:40:94",
                        state="reachable"))
        for n, leaf in enumerate((l1, l2)):
            port = f"bond{v}"
            member = f"swp{v}"
            interfaces.append(dict(hostname=leaf, ifname=port, type="bond", state="up",
                                   adminState="up", mtu=9000, master="bridge", vlan=v))
            interfaces.append(dict(hostname=leaf, ifname=member, type="bond_slave", state="up",
                                   adminState="up", mtu=9000, master=port, speed=25000))
            interfaces.append(dict(hostname=srv, ifname=f"eth{n + 1}", type="bond_slave",
                                   state="up", adminState="up", mtu=9000, master="bond0",
                                   macaddr=mac(srv, 1), speed=25000))
            lldp.append(dict(hostname=leaf, ifname=member, peerHostname=f"{srv}.example.com",
                             peerIfname=f"eth{n + 1}", subtype="interface name", mgmtIP="-"))
            lldp.append(dict(hostname=srv, ifname=f"eth{n + 1}", peerHostname=leaf,
                             peerIfname=member, subtype="interface name"))
            arp.append(dict(hostname=leaf, ipAddress=ip, oif=f"vlan{v}", macaddr=mac(srv, 1),
                            state="reachable"))
            macs.append(dict(hostname=leaf, mackey=str(v), macaddr=mac(srv, 1), vlan=v,
                             oif=port, flags="dynamic"))
            members[(leaf, v)].append(port)
    for (leaf, v), ports in members.items():
        vlans.append(dict(hostname=leaf, vlanName=f"vlan{v}", vlan=v, state="active",
                          interfaces=[*ports, "peerlink"]))
    # Routes: every leaf reaches every subnet behind the other pair over both spines.
    for leaf in LEAVES:
        pair = 0 if leaf in LEAVES[:2] else 2
        for v, net in vlan_if.items():
            routes.append(dict(hostname=leaf, vrf="evpn-vrf", prefix=f"{net}.0/24", nexthopIps=[],
                               oifs=[f"vlan{v}"], protocol="connected", ipvers=4))
        for si, (srv, (l1, l2, v)) in enumerate(SERVERS.items()):
            if leaf in (l1, l2):
                continue
            ups = [x for x in links() if x[0] == leaf]
            routes.append(dict(
                hostname=leaf, vrf="evpn-vrf", prefix=f"{vlan_if[v]}.{101 + si}/32",
                nexthopIps=[u[5].split("/")[0] for u in ups], oifs=[u[1] for u in ups],
                protocol="bgp", ipvers=4))
        assert pair in (0, 2)
    for spine in SPINES:
        for si, (srv, (l1, l2, v)) in enumerate(SERVERS.items()):
            downs = [x for x in links() if x[3] == spine and x[0] in (l1, l2)]
            routes.append(dict(
                hostname=spine, vrf="default", prefix=f"{vlan_if[v]}.{101 + si}/32",
                nexthopIps=[d[2].split("/")[0] for d in downs], oifs=[d[4] for d in downs],
                protocol="bgp", ipvers=4))
    for h in [*SPINES, *LEAVES]:
        routes.append(dict(hostname=h, vrf="default", prefix="127.0.0.0/8", protocol="kernel",
                           oifs=["lo"], ipvers=4))
        routes.append(dict(hostname=h, vrf="default", prefix="2001:db8::/32",
                           nexthopIps=["fe80::1"], oifs=["swp1"], protocol="bgp", ipvers=6))
    routes.append(dict(hostname="exit01", vrf="default", prefix="default", metric=4278198272,
                       ipvers=4))
    routes.append(dict(hostname="exit01", vrf="default", prefix="0.0.0.0/0",
                       nexthopIps=["10.255.8.1"], oifs=["swp51"], protocol="direct",
                       action="local", ipvers=4))
    mlag = [dict(hostname=h, systemId="44:39:39:ff:00:01" if h in LEAVES[:2] else
                 "44:39:39:ff:00:02", state="active", role="primary", peerLink="peerlink",
                 backupActive=h != "leaf04", mlagDualPortsCnt=2,
                 mlagSinglePortsCnt=1 if h == "leaf03" else 0) for h in LEAVES]
    vnis = []
    for li, leaf in enumerate(LEAVES):
        others = [loop[x] for x in LEAVES if x != leaf]
        for v in (13, 24):
            vnis.append(dict(
                hostname=leaf, vni=10000 + v, type="L2", ifname=f"vni{v}", vlan=v,
                state="down" if (leaf, v) == ("leaf02", 24) else "up", priVtepIp=loop[leaf],
                remoteVtepList=others[:-1] if (leaf, v) == ("leaf01", 13) else others,
                replicationType="ingressBGP", mcastGroup="0.0.0.0"))
        vnis.append(dict(hostname=leaf, vni=104001, type="L3", ifname="vni4001", vrf="evpn-vrf",
                         vlan=4001, state="up", priVtepIp=loop[leaf], mcastGroup="0.0.0.0"))
    devices = [dict(hostname=h, os="cumulus", version="4.2.1" if h in SPINES else "3.7.5",
                    vendor="Cumulus", model="vx", status="alive", address=f"192.168.0.{i + 10}",
                    architecture="x86-64", bootupTimestamp=float(T0 // 1000 - 3600))
               for i, h in enumerate([*SPINES, *LEAVES, *SERVERS])]
    devices.append(dict(hostname="exit01", os="nxos", version="9.3(5)", vendor="Cisco",
                        model="n9k", status="alive", address="192.168.0.50",
                        bootupTimestamp=float(T0 // 1000 - 60), architecture="x86-64"))
    devices.append(dict(hostname="old01", os="eos", version="4.20.1F", vendor="Arista",
                        model="veos", status="alive", address="192.168.0.60",
                        bootupTimestamp=1.0, active=False, timestamp=T1))
    poller = [dict(hostname=h, service=s, status=0, pollExcdPeriodCount=0)
              for h in [*SPINES, *LEAVES] for s in ("device", "bgp", "routes")]
    poller += [dict(hostname="192.168.0.99", service="device", status=2011),
               dict(hostname="exit01", service="routes", status=2009, pollExcdPeriodCount=3),
               dict(hostname="192.168.0.50", service="device", status=418)]
    ios = ("hostname exit01\n!\ninterface Ethernet1/1\n  description up\n  switchport access vlan 13"
           "\n!\ninterface Ethernet1/2\n  switchport mode trunk\n  switchport trunk native vlan 7\n"
           "!\nrouter bgp 65015\n  neighbor 10.255.8.1\n    remote-as 65020\n!\n")
    cls = ("auto swp13\niface bond13\n    bridge-access 13\n\niface bond24\n    bridge-pvid 24\n\n"
           "iface bridge\n    bridge-ports bond13 bond24 peerlink\n    bridge-vids 13 24\n")
    configs = [dict(hostname="exit01", config=ios)] + [
        dict(hostname=h, config=cls) for h in LEAVES]
    inventory = [dict(hostname="exit01", name="port-1/1", type="xcvr", status="present"),
                 dict(hostname="exit01", name="fan-1", type="fan", status="present")]
    interfaces += [dict(hostname="exit01", ifname=f"Ethernet1/1/{i}", type="ethernet", state="down",
                        adminState="up" if i == 1 else "down", mtu=1500, reason="linkDown")
                   for i in (1, 2)]
    fs = [dict(hostname=h, mountPoint="/", usedPercent=10 * i, totalSize="6G")
          for i, h in enumerate([*SPINES, *LEAVES])]
    # One key through time: up, down, up, deleted.
    interfaces += [
        dict(hostname="spine01", ifname="swp99", type="ethernet", adminState="up", mtu=9216,
             state=s, timestamp=t, active=a, numChanges=n)
        for s, t, a, n in (("up", T0 - 3000, True, 1), ("down", T0 - 2000, True, 2),
                           ("up", T0 - 1000, True, 3), ("up", T0 - 500, False, 3))]
    out = {
        "interfaces": interfaces, "lldp": lldp, "routes": routes, "arpnd": arp, "macs": macs,
        "bgp": bgp, "ospfIf": ospf_if, "ospfNbr": ospf_nbr, "vlan": vlans, "mlag": mlag,
        "evpnVni": vnis, "device": devices, "sqPoller": poller, "devconfig": configs,
        "inventory": inventory, "fs": fs,
    }
    return {t: frame(spark, t, r).cache() for t, r in out.items()}
