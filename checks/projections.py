"""Network tables derived from the given tables."""

from checks.registry import projection

# Change log of one object per user; event times are unique.
projection("log", """
    select concat('ns', user_id % 5) as namespace, concat('h', user_id) as hostname,
           @ms(ts) as timestamp, event_type as state, value,
           event_type <> 'error' as active, event_id, user_id
    from events""")

# A key that owns a third of all rows.
projection("hotlog", """
    select case when event_id % 3 = 0 then 'hot' else concat('h', user_id) end as hostname,
           concat('ns', user_id % 2) as namespace, @ms(ts) as timestamp, event_type as state,
           value, event_id
    from events""")

projection("route_nums", """
    select p_partkey, 8 + p_size % 17 as plen,
           ((p_partkey % 1000000007) * 2654435761) % 4294967296 as raw,
           p_type, p_brand, p_retailprice, p_size
    from part""")

projection("route_nets", """
    select *, raw - raw % cast(pow(2, 32 - plen) as bigint) as net from route_nums""")

projection("routes", """
    select concat('ns', p_partkey % 3) as namespace, concat('h', p_partkey % 10) as hostname,
           case when p_partkey % 4 = 0 then 'red' else 'default' end as vrf,
           concat(cast(@div(net, 16777216) as string), '.',
                  cast(@div(net, 65536) % 256 as string), '.',
                  cast(@div(net, 256) % 256 as string), '.', cast(net % 256 as string), '/',
                  cast(plen as string)) as prefix,
           min(plen) as plen, min(net) as net, min(lower(p_type)) as protocol,
           @list(concat('10.0.0.', cast(min(p_size) as string))) as nexthopIps,
           @list(concat('eth', cast(min(p_size) % 8 as string)),
                 concat('eth', cast(max(p_size) % 4 as string))) as oifs,
           cast(min(p_size) as bigint) as metric, cast(4 as bigint) as ipvers,
           min(p_partkey) as timestamp, true as active
    from route_nets group by 1, 2, 3, 4
    union all
    select distinct concat('ns', p_partkey % 3), concat('h', p_partkey % 10), 'default',
           '0.0.0.0/0', 0, cast(0 as bigint), 'static', @list('10.0.0.254'), @list('eth0'),
           cast(20 as bigint), cast(4 as bigint), cast(1 as bigint), true
    from part where p_size = 50""")

projection("addresses", """
    select o_orderkey, num, concat('ns', o_orderkey % 3) as namespace,
           concat('h', o_orderkey % 10) as hostname,
           case when o_orderkey % 5 = 0 then 'red' else 'default' end as vrf,
           concat(cast(@div(num, 16777216) as string), '.',
                  cast(@div(num, 65536) % 256 as string), '.',
                  cast(@div(num, 256) % 256 as string), '.', cast(num % 256 as string))
           as address
    from (select o_orderkey,
                 ((o_orderkey % 1000000007) * 2654435761 + 97) % 4294967296 as num
          from orders) o""")

# Eight interfaces per host.
projection("ifs", """
    select concat('ns', @div(c_custkey, 8) % 3) as namespace,
           concat('h', @div(c_custkey, 8)) as hostname,
           concat('swp', c_custkey % 8) as ifname,
           case c_custkey % 8 when 0 then 'loopback' when 6 then 'vlan' when 7 then 'bond_slave'
                else 'ethernet' end as type,
           case when c_acctbal < 0 then 'down' when c_mktsegment = 'MACHINERY' and
                c_custkey % 8 > 3 then 'down' else 'up' end as state,
           case when c_nationkey = 7 then 'down' else 'up' end as adminState,
           cast(case when c_nationkey % 9 = 0 then 1500 else 9216 end as bigint) as mtu,
           cast(case when c_nationkey % 8 = 1 then 10000 else 25000 end as bigint) as speed,
           cast(case when c_custkey % 8 = 6 then 10 + c_nationkey % 6 else 0 end as int) as vlan,
           case c_custkey % 8 when 7 then concat('bond', @div(c_custkey, 8) % 4)
                when 5 then 'bridge' when 4 then 'red' else '' end as master,
           concat('44:38:39:00:', lpad(cast(c_nationkey as string), 2, '0'), ':',
                  lpad(cast(c_custkey % 100 as string), 2, '0')) as macaddr,
           case when c_custkey % 8 in (1, 2, 3)
                then @list(concat('10.', cast(@div(c_custkey, 8) % 250 as string), '.',
                           cast(c_custkey % 8 as string), '.', cast(c_nationkey as string),
                           case when c_custkey % 3 = 0 then '/31' else '/24' end))
                when c_custkey % 8 = 0
                then @list(concat('172.16.', cast(@div(c_custkey, 8) % 250 as string), '.1/32'))
                else @list('192.168.0.1/24') end as ipAddressList,
           case when c_custkey % 8 = 0
                then @list(concat('2001:db8::', cast(@div(c_custkey, 8) as string), '/128'),
                           concat('fe80::', cast(c_custkey as string), '/64'))
                else @list(concat('fe80::', cast(c_custkey as string), '/64'))
                end as ip6AddressList,
           cast(c_nationkey as bigint) as numChanges, c_custkey as ifindex,
           c_custkey as timestamp, true as active, '' as reason
    from customer""")

# swp1 of host i is linked to swp2 of host i+3 (same namespace); some names are full
# and some ports unknown.
projection("lldp", """
    select i.namespace, i.hostname, i.ifname,
           concat('h', cast(cast(replace(hostname, 'h', '') as bigint)
                  + case when ifname = 'swp1' then 3 else -3 end as string),
                  case when timestamp % 5 = 0 then '.example.com' else '' end) as peerHostname,
           case when timestamp % 7 = 0 then '-' when ifname = 'swp1' then 'swp2'
                else 'swp1' end as peerIfname,
           concat('44:38:39:00:', lpad(cast(numChanges as string), 2, '0'), ':',
                  lpad(cast((timestamp + 25) % 100 as string), 2, '0')) as peerMacaddr,
           case when ifname = 'swp1' then timestamp + 25 else timestamp - 25 end as peerIfindex,
           case when timestamp % 14 = 0 then 'mac address' when timestamp % 7 = 0
                then 'locally assigned' else 'interface name' end as subtype,
           case when timestamp % 11 = 0 then '-' else '10.9.9.9' end as mgmtIP,
           i.timestamp, true as active
    from ifs i where ifname in ('swp1', 'swp2')""")

# Two sessions per device, to the devices three before and after it.
projection("bgp_ends", """
    select s_suppkey as k, s_suppkey + d as pk, d, s_nationkey, s_acctbal
    from supplier cross join (select 3 as d union all select -3 as d) x
    where s_suppkey + d >= 0""")

projection("bgp", """
    select concat('ns', k % 3) as namespace, concat('h', k) as hostname, 'default' as vrf,
           concat('10.7.', cast(pk % 200 as string), '.',
                  cast(k % 200 as string)) as peer,
           case when s_acctbal < 4000 then '' else 'ipv4' end as afi,
           case when s_acctbal < 4000 then '' else 'unicast' end as safi,
           cast(65000 + k % 7 as bigint) as asn,
           cast(65000 + pk % 7 + case when s_nationkey % 6 = 0 then 1 else 0 end as bigint)
           as peerAsn,
           case when s_acctbal < 4000 then 'NotEstd' when s_nationkey = 3 then 'dynamic'
                else 'Established' end as state,
           concat('10.7.', cast(pk % 200 as string), '.', cast(k % 200 as string)) as peerIP,
           concat('10.7.', cast(k % 200 as string), '.', cast(pk % 200 as string))
           as updateSource,
           '' as peerHostname, concat('swp', case when d = 3 then 1 else 2 end) as ifname,
           case when s_nationkey % 4 = 0 then 'Hold Timer' when s_nationkey % 4 = 1 then 'None'
                else '' end as reason,
           case when s_nationkey % 8 = 0 then 'expired' else '' end as notificnReason,
           case when s_nationkey % 5 = 0 then @list('l2vpn evpn') else @list('x') end as raw_adv,
           s_nationkey, k as timestamp, cast(floor(s_acctbal) as bigint) as updatesRx,
           cast(k % 13 as bigint) as updatesTx, cast(k * 3 as double) as estdTime,
           case when k % 9 = 0 then 'True' else 'False' end as rrclient, true as active
    from bgp_ends""")

projection("ospf_if", """
    select concat('ns', k % 3) as namespace, concat('h', k) as hostname, 'default' as vrf,
           concat('swp', case when d = 3 then 1 else 2 end) as ifname,
           case when s_nationkey % 10 = 0 then '0.0.0.1' else '0.0.0.0' end as area,
           s_nationkey % 12 = 0 as areaStub,
           case when s_nationkey = 5 then 'down' when s_nationkey = 6 then 'adminDown'
                else 'up' end as state,
           s_nationkey = 8 as passive,
           cast(case when s_nationkey % 7 = 0 then 20 else 10 end as bigint) as helloTime,
           cast(40 as bigint) as deadTime, cast(5 as bigint) as retxTime,
           case when s_nationkey = 9 then 'broadcast' else 'p2p' end as networkType,
           concat('10.8.', cast(case when d = 3 then k else pk end % 200 as string), '.',
                  case when d = 3 then '0' else '1' end, '/31') as ipAddress,
           false as isUnnumbered,
           concat('10.0.0.', cast(case when s_nationkey = 11 then 1 else k % 250 end as string))
           as routerId, k as timestamp, true as active
    from bgp_ends""")

projection("ospf_nbr", """
    select namespace, hostname, vrf, ifname, 'full' as state,
           concat(replace(substr(ipAddress, 1, length(ipAddress) - 4), ' ', ''),
                  case when ipAddress like '%.0/31' then '1' else '0' end) as peerIP,
           '' as ipAddress, timestamp % 4 as numChanges, timestamp as lastChangeTime,
           timestamp, true as active
    from ospf_if where helloTime = 10""")

projection("vnis", """
    select concat('ns', h % 2) as namespace, concat('h', h) as hostname, 10000 + v as vni,
           case when v % 9 = 0 then 'L3' else 'L2' end as type, concat('vni', v) as ifname,
           case when lo > 1 then 0 else v end as vlan,
           case when hi < 50 then 'down' else 'up' end as state,
           concat('10.2.2.', h) as priVtepIp, '' as secVtepIp,
           case when n % 2 = 0 then @list(concat('10.2.2.', (h + 1) % 20),
                concat('10.2.2.', (h + 2) % 20)) else @list(concat('10.2.2.', (h + 1) % 20)) end
           as remoteVtepList,
           case when v % 5 = 0 then 'multicast' else 'ingressBGP' end as replicationType,
           case when h % 2 = 0 or v % 5 <> 0 then '0.0.0.0' when n % 7 = 0 then '239.1.1.2'
                else '239.1.1.1' end as mcastGroup,
           case when v % 9 = 0 then 'red' else '' end as vrf, cast(0 as bigint) as numMacs,
           n as timestamp, true as active
    from (select l_suppkey % 20 as h, l_partkey % 30 as v, min(l_quantity) as lo,
                 max(l_quantity) as hi, count(*) as n
          from lineitem group by 1, 2) g""")

projection("svis", """
    select distinct concat('ns', h % 2) as namespace, concat('h', h) as hostname,
           concat('vlan', v) as ifname, cast(v as bigint) as vlan,
           case when v % 4 = 0 and h = 3 then 'blue' when v % 4 = 0 then 'red'
                else 'default' end as vrf,
           case when h % 2 = 1 then '44:39:39:ff:40:94'
                else concat('44:39:39:ff:40:0', cast(v % 3 as string)) end as macaddr
    from (select l_suppkey % 20 as h, l_partkey % 30 as v from lineitem) g""")

projection("devices", """
    select concat('ns', s_suppkey % 3) as namespace, concat('h', s_suppkey) as hostname,
           concat('192.168.', cast(@div(s_suppkey, 250) as string), '.',
                  cast(s_suppkey % 250 as string)) as address,
           case s_nationkey % 3 when 0 then 'eos' when 1 then 'nxos' else 'cumulus' end as os,
           concat(cast(s_nationkey % 5 as string), '.', cast(s_suppkey % 12 as string),
                  case when s_suppkey % 4 = 0 then 'a' else '' end) as version,
           concat('m', cast(s_nationkey % 4 as string)) as model,
           concat('v', cast(s_nationkey % 3 as string)) as vendor,
           'x86' as architecture, 'alive' as status, cast(s_suppkey as double) as bootupTimestamp,
           s_acctbal > 0 as active, s_suppkey * 100000 + 7 as timestamp
    from supplier""")

# Poll results: one row per order.
projection("polls", """
    select concat('ns', o_custkey % 3) as namespace, concat('h', o_custkey % 120) as hostname,
           case substr(o_orderpriority, 1, 1) when '1' then 'device' when '2' then 'bgp'
                when '3' then 'routes' else 'macs' end as service,
           cast(case when o_orderstatus = 'F' then 2011 when o_orderkey % 50 = 3 then 418
                     else 0 end as bigint) as status,
           o_orderkey * 20000 as timestamp, cast(floor(o_totalprice) as bigint) as totalTime,
           cast(floor(o_totalprice) as bigint) % 1000 as gatherTime, o_orderkey % 4 as
           pollExcdPeriodCount, true as active
    from orders""")

projection("edges", """
    select distinct concat('ns', l_suppkey % 2) as namespace,
           case l_returnflag when 'A' then 'lldp' when 'N' then 'bgp' else 'ospf' end as service,
           concat('n', l_suppkey) as src, concat('n', l_suppkey + 2 * (l_partkey % 40)) as dst
    from lineitem""")

projection("vlans", """
    select concat('ns', h % 3) as namespace, concat('h', h) as hostname,
           concat('vlan', v) as vlanName, cast(v as bigint) as vlan,
           case when n % 5 = 0 then 'suspend' else 'active' end as state, members as interfaces
    from (select p_partkey % 40 as h, p_size as v, count(*) as n,
                 @list(concat('swp', min(p_partkey) % 8), concat('swp', max(p_partkey) % 8))
                 as members
          from part group by 1, 2) g""")

projection("macs", """
    select concat('ns', s % 3) as namespace, concat('h', s) as hostname,
           cast(q as string) as mackey, q as vlan,
           concat('44:38:39:00:00:', lpad(cast(p % 100 as string), 2, '0')) as macaddr,
           concat('swp', cast(lo % 8 as string)) as oif,
           case when n % 3 = 0 then '10.2.2.9' else '' end as remoteVtepIp,
           case when n % 3 = 0 then 'remote' when n % 3 = 1 then 'dynamic' else 'static' end
           as flags, mx as timestamp, true as active
    from (select l_suppkey % 60 as s, l_partkey % 100 as p, cast(floor(l_quantity) as bigint) % 30 as q,
                 min(l_linenumber) as lo, count(*) as n, max(l_orderkey) as mx
          from lineitem group by 1, 2, 3) g""")

projection("arpnd", """
    select concat('ns', c % 3) as namespace, concat('h', c) as hostname,
           concat('swp', k % 8) as oif,
           case when k % 8 = 6 then concat('192.168.0.', cast(k % 200 as string))
                else concat('10.', cast(c % 250 as string), '.', cast(k % 8 as string), '.',
                            cast(k % 200 as string)) end as ipAddress,
           concat('44:38:39:00:00:', lpad(cast(k % 100 as string), 2, '0')) as macaddr,
           case when n = 0 then 'failed' when n = 1 then 'permanent' else 'reachable' end
           as state, k % 10 = 0 as remote, k as timestamp, true as active
    from (select o_custkey % 150 as c, o_orderkey as k, o_custkey % 7 as n from orders) g""")

# Histories of addresses on a bridged network: a third of the events are ARP entries, the
# others MAC entries, half of which are those of one MAC that moves among four ports.
_MAC = ("concat('00:00:00:00:', lpad(cast({u} % 100 as string), 2, '0'), ':', "
        "lpad(cast(@div({u}, 100) as string), 2, '0'))")
projection("arp_log", f"""
    select concat('ns', user_id % 3) as namespace, concat('h', user_id) as hostname,
           concat('10.20.', cast(@div(user_id, 200) as string), '.',
                  cast(user_id % 200 as string)) as ipAddress,
           'vlan10' as oif, {_MAC.format(u="user_id")} as macaddr,
           case when event_id % 7 = 0 then 'permanent' else 'reachable' end as state,
           false as remote, event_type <> 'error' as active, @ms(ts) as timestamp
    from events where event_id % 3 = 0""")

projection("mac_moves", """
    select case when event_id % 2 = 0 then 7 else user_id end as u, event_id % 4 as port,
           event_type, @ms(ts) as timestamp
    from events where event_id % 3 <> 0""")

projection("mac_log", f"""
    select concat('ns', u % 3) as namespace, concat('h', u) as hostname,
           {_MAC.format(u="u")} as macaddr, 10 as vlan,
           concat('swp', cast(port as string)) as oif,
           case when event_type = 'view' then 'remote' else 'dynamic' end as flags,
           event_type <> 'error' as active, timestamp
    from mac_moves""")

projection("svi_log", """
    select distinct concat('ns', user_id % 3) as namespace, concat('h', user_id) as hostname,
           'vlan10' as ifname, 'vlan' as type, 10 as vlan, 'red' as master,
           @list('10.20.0.1/16') as ipAddressList, @list('fe80::1/64') as ip6AddressList,
           cast(0 as bigint) as timestamp
    from events""")

# Polls of the VLANs of a host; a fifth of them fail.
projection("vlan_polls", """
    select concat('ns', user_id % 3) as namespace, concat('h', user_id) as hostname,
           @ms(ts) as timestamp, case when event_type = 'error' then 2011 else 0 end as status,
           event_id, user_id
    from events""")


# Chains: supplier k is linked to k+3 where its balance is positive.
projection("chain", """
    select concat('ns', s_suppkey % 3) as namespace, 'lldp' as service,
           concat('n', lpad(cast(s_suppkey as string), 9, '0')) as src,
           concat('n', lpad(cast(s_suppkey + 3 as string), 9, '0')) as dst, s_suppkey as k
    from supplier where s_acctbal > 0""")

# Small routed networks of four hosts in a row: lo, a link to the left, one to the right.
projection("rows4", """
    select s_suppkey as k, @div(s_suppkey, 4) as g, s_suppkey % 4 as pos, s_nationkey,
           cast(case when s_nationkey = 5 then 1500 else 9216 end as bigint) as mtu,
           (select max(s_suppkey) from supplier) as top
    from supplier""")

_IP = ("concat(cast(@div({n}, 16777216) as string), '.', cast(@div({n}, 65536) % 256 as string), "
       "'.', cast(@div({n}, 256) % 256 as string), '.', cast(({n}) % 256 as string))")
LOOP = _IP.format(n="167772160 + {k}")
RIGHT = _IP.format(n="2886729728 + 2 * ({k})")
LEFT = _IP.format(n="2886729729 + 2 * ({k})")

projection("path_ifs", f"""
    select concat('b', g) as namespace, concat('r', k) as hostname, 'lo' as ifname,
           'loopback' as type, mtu, @list(concat({LOOP.format(k="k")}, '/32')) as ipAddressList,
           concat('lo:', k) as macaddr
    from rows4
    union all
    select concat('b', g), concat('r', k), 'right', 'ethernet', mtu,
           @list(concat({RIGHT.format(k="k")}, '/31')), concat('right:', k)
    from rows4 where pos < 3 and k < top
    union all
    select concat('b', g), concat('r', k), 'left', 'ethernet', mtu,
           @list(concat({LEFT.format(k="k - 1")}, '/31')), concat('left:', k)
    from rows4 where pos > 0""")

projection("path_routes", f"""
    select concat('b', a.g) as namespace, concat('r', a.k) as hostname, 'default' as vrf,
           concat({LOOP.format(k="b.k")}, '/32') as prefix, 'ospf' as protocol,
           case when b.k > a.k then @list({LEFT.format(k="a.k")})
                else @list({RIGHT.format(k="a.k - 1")}) end as nexthopIps,
           case when b.k > a.k then @list('right') else @list('left') end as oifs,
           a.k as timestamp
    from rows4 a join rows4 b on a.g = b.g and a.k <> b.k""")

projection("path_arp", f"""
    select concat('b', g) as namespace, concat('r', k) as hostname, 'right' as oif,
           {LEFT.format(k="k")} as ipAddress, concat('left:', k + 1) as macaddr
    from rows4 where pos < 3 and k < top
    union all
    select concat('b', g), concat('r', k), 'left', {RIGHT.format(k="k - 1")},
           concat('right:', k - 1)
    from rows4 where pos > 0""")

# One request per network: first host to the host its nation names.
projection("path_requests", f"""
    select concat('q', g) as req, concat('b', g) as namespace,
           {LOOP.format(k="k")} as src,
           {LOOP.format(k="least(k + s_nationkey % 4, top)")} as dest, k,
           least(k + s_nationkey % 4, top) as dk
    from rows4 where pos = 0""")

# Fabrics: up to four leaves (l) and an exit (e) each; behind every leaf a polled server (s),
# an unpolled host and a polled host that has no routes and knows no neighbour (q).  Kind 0 has an anycast gateway, kind 1 one address with a MAC per
# leaf, kind 2 a central gateway on the exit.
projection("leaves", """
    select k, g, pos, g % 3 as kind, g * 4 as k0, concat('f', cast(g as string)) as namespace,
           concat('l', cast(k as string)) as leaf, concat('e', cast(g as string)) as exit,
           concat('s', cast(k as string)) as server,
           concat('10.1.0.', cast(10 + pos as string)) as server_ip,
           concat('10.1.0.', cast(50 + pos as string)) as host_ip,
           concat('q', cast(k as string)) as quiet,
           concat('10.1.0.', cast(90 + pos as string)) as quiet_ip,
           concat('10.9.0.', cast(1 + pos as string)) as vtep,
           case when g % 3 = 1 then concat('gw:', cast(k as string)) else 'gw' end as gw,
           k < top and pos < 3 as followed, pos > 0 or (k < top and pos < 3) as several
    from rows4 where k >= 0""")

projection("fabric_ifs", f"""
    select namespace, leaf as hostname, 'lo' as ifname, 'loopback' as type, '' as master,
           0 as vlan, @list(concat(vtep, '/32')) as ips, concat('lo:', leaf) as macaddr
    from leaves
    union all
    select namespace, leaf, 'vlan10', 'vlan', case when kind = 2 then '' else 'red' end, 10,
           @list(case when kind = 2 then '' else '10.1.0.1/24' end),
           case when kind = 2 then concat('svi:', leaf) else gw end from leaves
    union all
    select namespace, leaf, concat('swp', cast(n as string)), 'ethernet', 'bridge', 10, @list(''),
           concat('swp', cast(n as string), ':', leaf)
    from leaves cross join (select 1 as n union all select 2 union all select 3) x
    union all
    select namespace, quiet, 'eth0', 'ethernet', '', 0, @list(concat(quiet_ip, '/24')),
           concat('q:', server) from leaves
    union all
    select namespace, leaf, 'up', 'ethernet', '', 0, @list(concat({RIGHT.format(n="k", k="k")}, '/31')),
           concat('up:', leaf) from leaves
    union all
    select namespace, exit, concat('d', cast(pos as string)), 'ethernet', '', 0,
           @list(concat({LEFT.format(n="k", k="k")}, '/31')), concat('d:', leaf) from leaves
    union all
    select namespace, server, 'eth0', 'ethernet', '', 0, @list(concat(server_ip, '/24')),
           concat('s:', server) from leaves
    union all
    select namespace, exit, 'lo', 'loopback', '', 0, @list('10.9.0.9/32'), 'lo:e'
    from leaves where pos = 0
    union all
    select namespace, exit, 'dest', 'loopback', '', 0, @list('8.8.8.8/32'), 'dest:e'
    from leaves where pos = 0
    union all
    select namespace, exit, 'vlan10', 'vlan', 'red', 10, @list('10.1.0.1/24'), 'gw'
    from leaves where pos = 0 and kind = 2""")

projection("fabric_routes", f"""
    select namespace, server as hostname, 'default' as vrf, '0.0.0.0/0' as prefix,
           'static' as protocol, @list('10.1.0.1') as nexthopIps, @list('eth0') as oifs
    from leaves
    union all
    select namespace, server, 'default', '10.1.0.0/24', 'connected', @list(''), @list('eth0')
    from leaves
    union all
    select namespace, leaf, 'red', '0.0.0.0/0', 'bgp', @list({LEFT.format(n="k", k="k")}), @list('up')
    from leaves where kind < 2
    union all
    select namespace, leaf, 'red', '10.1.0.0/24', 'connected', @list(''), @list('vlan10')
    from leaves where kind < 2
    union all
    select namespace, leaf, 'default', '10.9.0.0/24', 'ospf', @list({LEFT.format(n="k", k="k")}),
           @list('up') from leaves
    union all
    select namespace, leaf, 'default', '0.0.0.0/0', 'ospf', @list({LEFT.format(n="k", k="k")}),
           @list('up') from leaves
    union all
    select namespace, exit, 'default', concat(vtep, '/32'), 'ospf',
           @list({RIGHT.format(n="k", k="k")}), @list(concat('d', cast(pos as string))) from leaves
    union all
    select namespace, exit, 'default', p, 'bgp', @list({RIGHT.format(n="k", k="k")}), @list('d0')
    from leaves cross join (select '10.1.0.0/24' as p union all select '9.9.9.0/24') x
    where pos = 0""")

projection("fabric_neighbours", """
    select a.namespace, a.leaf, a.kind, a.k = b.k as own, b.vtep, 1 as port,
           b.server_ip as ip, concat('s:', b.server) as mac
    from leaves a join leaves b on a.g = b.g
    union all
    select a.namespace, a.leaf, a.kind, a.k = b.k, b.vtep, 2, b.host_ip, concat('u:', b.server)
    from leaves a join leaves b on a.g = b.g
    union all
    select namespace, leaf, kind, true, vtep, 3, quiet_ip, concat('q:', server) from leaves""")

projection("fabric_arp", f"""
    select namespace, leaf as hostname, 'vlan10' as oif, ip as ipAddress, mac as macaddr,
           not own as remote from fabric_neighbours
    union all
    select namespace, leaf, 'up', {LEFT.format(n="k", k="k")}, concat('d:', leaf), false from leaves
    union all
    select namespace, exit, concat('d', cast(pos as string)), {RIGHT.format(n="k", k="k")},
           concat('up:', leaf), false from leaves
    union all
    select namespace, server, 'eth0', '10.1.0.1', gw, false from leaves""")

projection("fabric_macs", """
    select namespace, leaf as hostname, mac as macaddr, 10 as vlan,
           case when own then concat('swp', cast(port as string)) else 'vxlan' end as oif,
           case when own then '' else vtep end as remoteVtepIp
    from fabric_neighbours
    union all
    select namespace, leaf, 'gw', 10, 'vxlan', '10.9.0.9' from leaves where kind = 2""")

projection("fabric_requests", """
    select concat('out', cast(k as string)) as req, namespace, server_ip as src, '8.8.8.8' as dest
    from leaves
    union all
    select concat('host', cast(k as string)), namespace, host_ip, '8.8.8.8' from leaves
    where kind < 2
    union all
    select concat('link', cast(k as string)), namespace, host_ip,
           concat('10.1.0.', cast(11 + pos as string)) from leaves where kind < 2 and followed
    union all
    select concat('flood', cast(k as string)), namespace, host_ip, quiet_ip from leaves
    where kind < 2
    union all
    select concat('loop', cast(k as string)), namespace, server_ip, '9.9.9.9' from leaves""")

# Rows of up to four bridges; an endpoint sits behind the last, its MAC is known along the
# row.  Kind 1 lacks it on the third bridge; kind 2 starts with a bond, and every other row of
# these lacks it on the second bridge.  The second bridge's loopback is a neighbour of the first.
projection("bridges", """
    select k, g, pos, g * 4 as k0, g % 3 as kind, concat('w', cast(g as string)) as namespace,
           concat('w', cast(k as string)) as hostname, pos < 3 and k < top as followed,
           concat('e:', cast(g as string)) as mac,
           concat('10.60.', cast(@div(g, 200) as string), '.', cast(g % 200 as string)) as endpoint,
           concat('10.61.', cast(@div(k, 200) as string), '.', cast(k % 200 as string)) as loopback,
           concat('10.61.', cast(@div(k + 1, 200) as string), '.', cast((k + 1) % 200 as string))
           as next_loopback,
           not (g % 3 = 1 and pos = 2) and not (g % 3 = 2 and g % 2 = 0 and pos = 1) as knows,
           case when pos = 3 or k = top then 'edge' when g % 3 = 2 and pos = 0 then 'bond1'
                else 'right' end as port
    from rows4""")

projection("bridge_ifs", """
    select namespace, hostname, 'lo' as ifname, 'loopback' as type, '' as master, 0 as vlan,
           @list(concat(loopback, '/32')) as ips, concat('lo:', hostname) as macaddr from bridges
    union all
    select namespace, hostname, 'vlan10', 'vlan', '', 10, @list('10.60.0.1/16'),
           concat('svi:', hostname) from bridges
    union all
    select namespace, hostname, p, case when p = 'right' and port = 'bond1' then 'bond_slave'
                                        else 'ethernet' end,
           case when p = 'right' and port = 'bond1' then 'bond1' else '' end, 0, @list(''),
           concat(p, ':', hostname)
    from bridges cross join (select 'left' as p union all select 'right' union all select 'edge') x
    union all
    select namespace, hostname, 'bond1', 'bond', '', 0, @list(''), concat('bond1:', hostname)
    from bridges where port = 'bond1'""")

projection("bridge_arp", """
    select namespace, hostname, 'vlan10' as oif, endpoint as ipAddress, mac as macaddr
    from bridges where pos = 0
    union all
    select namespace, hostname, 'right', next_loopback, 'aa' from bridges
    where pos = 0 and followed""")

projection("bridge_lldp", """
    select namespace, hostname, 'right' as ifname, concat('w', cast(k + 1 as string)) as peerHostname,
           'left' as peerIfname from bridges where followed
    union all
    select namespace, hostname, 'left', concat('w', cast(k - 1 as string)), 'right'
    from bridges where pos > 0""")

# BGP rows of the first schema version: one row, a column group per family.
projection("bgp_v1", """
    select s_suppkey as timestamp, concat('h', s_suppkey) as hostname, '1.0' as sqvers,
           s_nationkey % 2 = 0 as v4Enabled, s_nationkey % 3 = 0 as v6Enabled,
           s_nationkey % 5 = 0 as evpnEnabled, s_nationkey as v4PfxRx, s_nationkey + 1 as v6PfxRx,
           s_nationkey + 2 as evpnPfxRx, s_nationkey % 2 = 0 as v4Advertised,
           s_nationkey % 4 = 0 as v4Received, s_nationkey % 7 = 0 as evpnAdvertised,
           s_nationkey % 3 = 0 as evpnReceived,
           case when s_nationkey % 4 = 0 then 'extended' when s_nationkey % 4 = 1 then 'standard'
                else 'extendedAndStandard' end as evpnSendCommunity
    from supplier""")

# The log as interfaces of few hosts, to be stored by host.
projection("slog", """
    select concat('ns', user_id % 5) as namespace, concat('h', user_id % 12) as hostname,
           concat('swp', user_id) as ifname, event_type as state,
           cast(event_id as bigint) as numChanges, @ms(ts) as timestamp,
           event_type <> 'error' as active, event_id % 10 = 0 as late
    from events""")
