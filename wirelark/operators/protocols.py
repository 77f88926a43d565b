"""Header structs of the protocols, each built from the bytes of its layer by Column expressions.

A field that its message doesn't have, or that lies past the end, is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelark.functions import detect
from wirelark.functions.bytesx import bits, ip4_text, ip6_text, let, lit, mac_text, take, text, uint, uint64, uint_le
from wirelark.functions.net import TFTP_OPS, flags_text, mqtt_length, named, quic_varint

__all__ = ["PROTOCOLS", "flags_text"]


def struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def bit(x: Column, at: int) -> Column:
    return bits(x, at, 1) == 1


def mac(b: Column, off: int | Column) -> Column:
    return F.when(F.length(b) >= lit(off) + 6, mac_text(take(b, off, 6)))


def ip4(b: Column, off: int | Column) -> Column:
    return ip4_text(take(b, off, 4))


def rest(b: Column, off: int | Column) -> Column:
    return take(b, off, F.length(b))


def ether(b: Column) -> Column:
    return struct(dst=mac(b, 0), src=mac(b, 6), type=uint(b, 12, 2))


def dot3(b: Column, _=None) -> Column:
    return struct(dst=mac(b, 0), src=mac(b, 6), len=uint(b, 12, 2))


def arp(b: Column) -> Column:
    return struct(hwtype=uint(b, 0, 2), ptype=uint(b, 2, 2), hwlen=uint(b, 4), plen=uint(b, 5), op=uint(b, 6, 2), hwsrc=mac(b, 8), psrc=ip4(b, 14), hwdst=mac(b, 18), pdst=ip4(b, 24))


def ipv4(b: Column) -> Column:
    first, tos, frag = uint(b, 0), uint(b, 1), uint(b, 6, 2)
    return struct(version=bits(first, 4, 4), ihl=bits(first, 0, 4), tos=tos, dscp=bits(tos, 2, 6), ecn=bits(tos, 0, 2), len=uint(b, 2, 2), id=uint(b, 4, 2), flags=bits(frag, 13, 3), frag=bits(frag, 0, 13), ttl=uint(b, 8), proto=uint(b, 9), chksum=uint(b, 10, 2), src=ip4(b, 12), dst=ip4(b, 16))


def ipv6(b: Column) -> Column:
    word = uint(b, 0, 4)
    return struct(version=bits(word, 28, 4), tc=bits(word, 20, 8), fl=bits(word, 0, 20), plen=uint(b, 4, 2), nh=uint(b, 6), hlim=uint(b, 7), src=ip6_text(take(b, 8, 16)), dst=ip6_text(take(b, 24, 16)))


def tcp(b: Column) -> Column:
    word = uint(b, 12, 2)
    return struct(sport=uint(b, 0, 2), dport=uint(b, 2, 2), seq=uint(b, 4, 4), ack=uint(b, 8, 4), dataofs=bits(word, 12, 4), reserved=bits(word, 9, 3), flags=bits(word, 0, 9), window=uint(b, 14, 2), chksum=uint(b, 16, 2), urgptr=uint(b, 18, 2))


def udp(b: Column) -> Column:
    return struct(sport=uint(b, 0, 2), dport=uint(b, 2, 2), len=uint(b, 4, 2), chksum=uint(b, 6, 2))


def icmp(b: Column) -> Column:
    kind, code = uint(b, 0), uint(b, 1)
    echo, stamp, masked = kind.isin(0, 8, 13, 14, 15, 16, 17, 18), kind.isin(13, 14), kind.isin(17, 18)
    return struct(
        type=kind, code=code, chksum=uint(b, 2, 2), id=F.when(echo, uint(b, 4, 2)), seq=F.when(echo, uint(b, 6, 2)), gw=F.when(kind == 5, ip4(b, 4)), ptr=F.when(kind == 12, uint(b, 4)), mtu=F.when((kind == 3) & (code == 4), uint(b, 6, 2)),
        ts_ori=F.when(stamp, uint(b, 8, 4)), ts_rx=F.when(stamp, uint(b, 12, 4)), ts_tx=F.when(stamp, uint(b, 16, 4)), addr_mask=F.when(masked, ip4(b, 8)),
    )


def icmpv6(b: Column) -> Column:
    kind = uint(b, 0)
    echo = kind.isin(128, 129)
    return struct(type=kind, code=uint(b, 1), chksum=uint(b, 2, 2), id=F.when(echo, uint(b, 4, 2)), seq=F.when(echo, uint(b, 6, 2)))


def coap(b: Column, _) -> Column:
    first, code = uint(b, 0), uint(b, 1)
    token = bits(first, 0, 4)
    after = rest(b, 4 + token)
    mark = F.locate("FF", F.regexp_replace(F.hex(after), "(..)", "$1 ")) - 1
    at = (mark / 3).cast("int")
    return struct(ver=bits(first, 6, 2), type=bits(first, 4, 2), tkl=token, code=code, code_class=bits(code, 5, 3), code_detail=bits(code, 0, 5), msg_id=uint(b, 2, 2), token=take(b, 4, token), payload=F.when(mark >= 0, rest(after, at + 1)))


def cotp(b: Column, _) -> Column:
    kind = uint(b, 1)
    data = kind >= 0xF0
    return struct(length=uint(b, 0), pdu_type=bits(kind, 4, 4) * 16, dst_ref=F.when(~data, uint(b, 2, 2)), src_ref=F.when(~data, uint(b, 4, 2)), class_option=F.when(~data, uint(b, 6)), tpdu_nr=F.when(data, bits(uint(b, 2), 0, 7)), eot=F.when(data, bits(uint(b, 2), 7, 1)))


def dhcp(b: Column, _) -> Column:
    from wirelark.functions.walkers import dhcp_options, dhcp_servers

    o = dhcp_options(rest(b, 240))
    option = lambda n: F.try_element_at(o, F.lit(n))
    return struct(
        op=uint(b, 0), htype=uint(b, 1), hlen=uint(b, 2), hops=uint(b, 3), xid=uint(b, 4, 4), secs=uint(b, 8, 2), flags=uint(b, 10, 2), ciaddr=ip4(b, 12), yiaddr=ip4(b, 16), siaddr=ip4(b, 20), giaddr=ip4(b, 24), chaddr=mac(b, 28),
        msg_type=uint(option(53), 0), server_id=ip4(option(54), 0), requested_ip=ip4(option(50), 0), lease_time=uint(option(51), 0, 4), subnet_mask=ip4(option(1), 0), router=ip4(option(3), 0), dns=dhcp_servers(rest(b, 240)),
    )


def dnp3(b: Column, _) -> Column:
    c, t, a, func = uint(b, 3), uint(b, 10), uint(b, 11), uint(b, 12)
    return struct(
        start=uint(b, 0, 2), length=uint(b, 2), control=c, dir=bit(c, 7), prm=bit(c, 6), fcb=bit(c, 5), fcv=bit(c, 4), link_func=bits(c, 0, 4), dst=uint_le(b, 4, 2), src=uint_le(b, 6, 2), transport_fin=bit(t, 7), transport_fir=bit(t, 6), transport_seq=bits(t, 0, 6),
        app_fir=bit(a, 7), app_fin=bit(a, 6), app_con=bit(a, 5), app_uns=bit(a, 4), app_seq=bits(a, 0, 4), app_func=func, iin=F.when(func.isin(129, 130), uint(b, 13, 2)),
    )


def dns(b: Column, _) -> Column:
    w = uint(b, 2, 2)
    return struct(id=uint(b, 0, 2), qr=bit(w, 15), opcode=bits(w, 11, 4), aa=bit(w, 10), tc=bit(w, 9), rd=bit(w, 8), ra=bit(w, 7), z=bit(w, 6), ad=bit(w, 5), cd=bit(w, 4), rcode=bits(w, 0, 4), qdcount=uint(b, 4, 2), ancount=uint(b, 6, 2), nscount=uint(b, 8, 2), arcount=uint(b, 10, 2))


def first_line(b: Column) -> Column:
    """Up to the first LF, without a CR at the end; NULL for bytes that aren't UTF-8."""
    return F.regexp_replace(F.regexp_extract(text(b), r"^([^\n]*)", 1), "\r$", "")


def arguments(line: Column) -> Column:
    """What follows the first space; empty without one."""
    return F.regexp_extract(line, r"^[^ ]* (.*)$", 1)


def word_of(line: Column) -> Column:
    return F.upper(F.regexp_extract(line, r"^\s*(\S*)", 1))


def reply(b: Column, line: Column) -> tuple[Column, Column, Column, Column]:
    """(is reply, code, text, multiline) of a line of three digits."""
    is_reply = detect.coded(b)
    return is_reply, F.when(is_reply, F.regexp_extract(line, "^([0-9]{3})", 1).try_cast("bigint")), F.when(is_reply, F.substring(line, 5, F.length(line))), F.coalesce(is_reply & (uint(b, 3) == 45), F.lit(False))


def ftp(b: Column, _) -> Column:
    line = first_line(b)
    is_reply, code, words, many = reply(b, line)
    digit = uint(b, 0).between(48, 57)
    command = F.when(~(digit & ~word_of(line).isin(detect.FTP_COMMANDS)), word_of(line))
    return struct(command=command, args=arguments(line), reply_code=code, reply_text=words, is_response=is_reply, is_multiline=many, raw=text(b))


def smtp(b: Column, _) -> Column:
    line = first_line(b)
    is_reply, code, words, many = reply(b, line)
    args = arguments(line)
    path = lambda verb: F.when(F.upper(args).startswith(verb), F.regexp_extract(args, "<([^>]*)>", 1))
    return struct(command=word_of(line), args=args, reply_code=code, reply_text=words, is_response=is_reply, is_multiline=many, mailfrom=path("FROM:"), rcptto=path("TO:"), raw=text(b))


def pop3(b: Column, _) -> Column:
    line, ok, err = first_line(b), detect.starts(b, "+OK"), detect.starts(b, "-ERR")
    words = F.when(ok, F.ltrim(F.substring(line, 4, F.length(line)))).when(err, F.ltrim(F.substring(line, 5, F.length(line))))
    return struct(command=word_of(line), args=arguments(line), is_ok=ok, is_err=err, response_text=words, is_response=ok | err, raw=text(b))


def imap(b: Column, _) -> Column:
    line, untagged, more = first_line(b), detect.starts(b, "* "), detect.starts(b, "+")
    tag = F.when(untagged, "*").when(more, "+").otherwise(F.regexp_extract(line, r"^(\S*)", 1))
    second = F.upper(F.regexp_extract(line, r"^\S+ +(\S*)", 1))
    command = F.when(more, "+").otherwise(second)
    args = F.when(more, F.trim(F.regexp_extract(line, r"^\+ ?(.*)$", 1))).otherwise(F.trim(F.regexp_extract(line, r"^\S+ +\S+ *(.*)$", 1)))
    status = F.when(command.isin(detect.IMAP_STATUSES), command)
    tagged = ~untagged & ~more & status.isNotNull()
    return struct(tag=tag, command=command, args=args, status=status, text=args, is_untagged=untagged, is_continuation=more, is_tagged_response=tagged, is_client_command=~untagged & ~more & status.isNull(), raw=text(b))


def http(b: Column, _) -> Column:
    line = first_line(b)
    response = detect.starts(b, "HTTP/")
    part = lambda n: F.try_element_at(F.split(line, " "), F.lit(n))
    head = F.regexp_extract(detect.latin(b), r"(?s)^(.*?)\r\n\r\n", 1)
    lines = F.filter(F.slice(F.split(head, "\r\n"), 2, 1 << 20), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("value")))
    return struct(method=F.when(~response, part(1)), uri=F.when(~response, part(2)), version=F.when(response, part(1)).otherwise(part(3)), status_code=F.when(response, part(2).try_cast("bigint")), reason=F.when(response, F.regexp_extract(line, r"^\S+ \S+ (.*)$", 1)), headers=F.when(head != "", pairs), body_start=F.when(head != "", F.length(head) + 4))


def http_header(headers: Column, name: str) -> Column:
    """First value of a header, in any case."""
    return F.try_element_at(F.filter(headers, lambda x: F.lower(x["name"]) == name.lower()), F.lit(1))["value"]


def http2(b: Column, _) -> Column:
    at = F.when(detect.starts(b, detect.HTTP2_PREFACE), 24).otherwise(0)
    return struct(frame_type=uint(b, at + 3), flags=uint(b, at + 4), stream_id=uint(b, at + 5, 4).bitwiseAND(0x7FFFFFFF), length=uint(b, at, 3))


def iec104(b: Column, _) -> Column:
    low = uint(b, 2)
    i_form, s_form = bits(low, 0, 1) == 0, bits(low, 0, 2) == 1
    kind = F.when(i_form, "I").when(s_form, "S").otherwise("U")
    asdu = lambda c: F.when(i_form, c)
    return struct(
        start=uint(b, 0), apdu_length=uint(b, 1), type=kind, tx=asdu(F.shiftright(uint_le(b, 2, 2), 1)), rx=F.when(i_form | s_form, F.shiftright(uint_le(b, 4, 2), 1)), u_type=F.when(~i_form & ~s_form, low), type_id=asdu(uint(b, 6)), sq=asdu(bit(uint(b, 7), 7)), num_objects=asdu(bits(uint(b, 7), 0, 7)),
        cot=asdu(bits(uint(b, 8), 0, 6)), org=asdu(uint(b, 9)), common_addr=asdu(uint_le(b, 10, 2)), ioa=asdu(uint_le(b, 12, 3)),
    )


def l2tp(b: Column, _) -> Column:
    f = uint(b, 0, 2)
    control, has_len, has_seq = bit(f, 15), bit(f, 14), bit(f, 11)
    at = F.when(has_len, 4).otherwise(2)
    return struct(flags=f, version=bits(f, 0, 4), msg_type=bits(f, 15, 1), length=F.when(has_len, uint(b, 2, 2)), tunnel_id=uint(b, at, 2), session_id=uint(b, at + 2, 2), ns=F.when(has_seq, uint(b, at + 4, 2)), nr=F.when(has_seq | (control & has_seq), uint(b, at + 6, 2)))


def modbus(b: Column, _) -> Column:
    func = uint(b, 7)
    fails = func >= 0x80
    on = lambda codes, c: F.when(func.isin(codes), c)
    return struct(
        trans_id=uint(b, 0, 2), proto_id=uint(b, 2, 2), length=uint(b, 4, 2), unit_id=uint(b, 6), func_code=func, except_code=F.when(fails, uint(b, 8)), start_addr=on([1, 2, 3, 4, 5, 6, 15, 16], uint(b, 8, 2)), quantity=on([1, 2, 3, 4, 15, 16], uint(b, 10, 2)), byte_count=on([1, 2, 3, 4, 23], uint(b, 8)),
        output_value=on([5], uint(b, 10, 2)), register_val=on([6], uint(b, 10, 2)), coil_status=on([1, 2], uint(b, 9)), sub_func=on([8], uint(b, 8, 2)), ref_addr=on([22], uint(b, 8, 2)), and_mask=on([22], uint(b, 10, 2)), or_mask=on([22], uint(b, 12, 2)), data=rest(b, 8),
    )


def mqtt(b: Column, _) -> Column:
    first = uint(b, 0)
    kind, size = bits(first, 4, 4), mqtt_length(b, 1)
    at = 1 + size["size"]
    topic_len, qos = F.when(kind == 3, uint(b, at, 2)), bits(first, 1, 2)
    name_len = F.when(kind == 1, uint(b, at, 2))
    level_at = at + 2 + name_len
    flags = F.when(kind == 1, uint(b, level_at + 1))
    id_len = F.when(kind == 1, uint(b, level_at + 4, 2))
    after = at + 2 + topic_len
    acks = kind.isin(4, 5, 6, 7, 8, 9, 10, 11)
    return struct(
        msg_type=kind, dup=bit(first, 3), qos=qos, retain=bit(first, 0), remaining_length=size["value"], topic_len=topic_len, topic=text(take(b, at + 2, topic_len)), msgid=F.when((kind == 3) & (qos > 0), uint(b, after, 2)).when(acks, uint(b, at, 2)), value=F.when(kind == 3, rest(b, after + F.when(qos > 0, 2).otherwise(0))),
        proto_name=text(take(b, at + 2, name_len)), proto_level=F.when(kind == 1, uint(b, level_at)), connect_flags=flags, klive=F.when(kind == 1, uint(b, level_at + 2, 2)), client_id=text(take(b, level_at + 6, id_len)), usernameflag=bit(flags, 7), passwordflag=bit(flags, 6), willretainflag=bit(flags, 5), willQOSflag=bits(flags, 3, 2), willflag=bit(flags, 2), cleansess=bit(flags, 1),
        sess_present_flag=F.when(kind == 2, bits(uint(b, at), 0, 1)), retcode=F.when(kind == 2, uint(b, at + 1)), retcodes=F.when(kind == 9, rest(b, at + 2)),
    )


def mqttsn(b: Column, _) -> Column:
    long = uint(b, 0) == 1
    at, size = F.when(long, 3).otherwise(1), F.when(long, uint(b, 1, 2)).otherwise(uint(b, 0))
    kind, body = uint(b, at), at + 1
    on = lambda kinds, c: F.when(kind.isin(kinds), c)
    flags = on([4, 7, 12, 18, 19, 20, 26], uint(b, body))
    return struct(
        length=size, type=kind, flags=flags, dup=bit(flags, 7), qos=bits(flags, 5, 2), retain=bit(flags, 4), will=bit(flags, 3), cleansess=bit(flags, 2), tid_type=bits(flags, 0, 2), gw_id=on([0, 2], uint(b, body)), duration=F.when(kind == 0, uint(b, body + 1, 2)).when(kind == 4, uint(b, body + 2, 2)).when(kind == 24, uint(b, body, 2)), radius=on([1], uint(b, body)),
        prot_id=on([4], uint(b, body + 1)), return_code=F.when(kind == 5, uint(b, body)).when(kind.isin(11, 13), uint(b, body + 4)).when(kind == 19, uint(b, body + 5)), tid=F.when(kind.isin(10, 11, 13), uint(b, body, 2)).when(kind.isin(12, 19), uint(b, body + 1, 2)), mid=F.when(kind.isin(10, 11, 13), uint(b, body + 2, 2)).when(kind.isin(12, 19), uint(b, body + 3, 2)).when(kind.isin(14, 15, 16, 21), uint(b, body, 2)).when(kind.isin(18, 20), uint(b, body + 1, 2)),
        client_id=F.when(kind == 4, text(rest(b, body + 4))).when(kind == 22, text(rest(b, body))), topic_name=F.when(kind == 10, text(rest(b, body + 4))).when(kind.isin(18, 20), text(rest(b, body + 3))), will_topic=on([7, 26], text(rest(b, body + 1))), data=on([12], rest(b, body + 5)), will_msg=on([9, 28], rest(b, body)), gw_addr=on([2], rest(b, body + 1)),
    )


def quic(b: Column, _) -> Column:
    first = uint(b, 0)
    long = bit(first, 7)
    kind = F.when(long, bits(first, 4, 2))
    dlen = F.when(long, uint(b, 5))

    def fields(slen_at: Column, after: Column) -> Column:
        """slen_at: of the source id's length; after: behind that id. Both are worked out once, as much hangs on them."""
        size = F.when(kind == 0, F.pow(F.lit(2), F.shiftright(uint(b, after), 6)).cast("int") + quic_varint(b, after).cast("int")).otherwise(0)
        return struct(header_form=bits(first, 7, 1), fixed_bit=bits(first, 6, 1), packet_type=F.when(long, bits(first, 4, 2)).otherwise(F.lit(-1)), version=F.when(long, uint(b, 1, 4)), long_packet_type=kind, packet_number_len=bits(first, 0, 2) + 1, dst_conn_id_len=dlen, src_conn_id_len=F.when(long, uint(b, slen_at)), dst_conn_id=take(b, 6, dlen), src_conn_id=take(b, slen_at + 1, F.when(long, uint(b, slen_at))), length=F.when(kind != 3, let(after + size, lambda at: quic_varint(b, at))))

    return let((6 + dlen).cast("int"), lambda s: let((s + 1 + F.when(long, uint(b, s))).cast("int"), lambda after: fields(s, after)))


def s7comm(b: Column, _) -> Column:
    kind = uint(b, 1)
    ack = kind.isin(2, 3)
    at = F.when(ack, 12).otherwise(10)
    return struct(protocol_id=uint(b, 0), rosctr=kind, reserved=uint(b, 2, 2), pdu_ref=uint(b, 4, 2), param_length=uint(b, 6, 2), data_length=uint(b, 8, 2), error_class=F.when(ack, uint(b, 10)), error_code=F.when(ack, uint(b, 11)), function=F.when(uint(b, 6, 2) > 0, uint(b, at)), item_count=F.when(uint(b, 6, 2) > 1, uint(b, at + 1)))


def ssh(b: Column, _) -> Column:
    banner = detect.starts(b, "SSH-")
    return struct(packet_length=F.when(~banner, uint(b, 0, 4)), padding_length=F.when(~banner, uint(b, 4)), message_type=F.when(~banner, uint(b, 5)), version_string=F.when(banner, F.regexp_extract(detect.latin(b), r"(?s)^(.*?)(?:\r\n|$)", 1)))


def tftp(b: Column, _) -> Column:
    op = uint(b, 0, 2)
    request = op.isin(1, 2)
    names = F.split(detect.latin(rest(b, 2)), "\u0000")
    part = lambda i: F.try_element_at(names, F.lit(i))
    return struct(opcode=op, op_name=named(op, TFTP_OPS), filename=F.when(request, part(1)), mode=F.when(request, part(2)), block_num=F.when(op.isin(3, 4), uint(b, 2, 2)), data=F.when(op == 3, rest(b, 4)), error_code=F.when(op == 5, uint(b, 2, 2)), error_msg=F.when(op == 5, F.substring_index(detect.latin(rest(b, 4)), "\u0000", 1)))


def tls(b: Column, _) -> Column:
    return struct(type=uint(b, 0), version=uint(b, 1, 2), len=uint(b, 3, 2), fragment=rest(b, 5))


def tpkt(b: Column, _) -> Column:
    return struct(version=uint(b, 0), reserved=uint(b, 1), length=uint(b, 2, 2))


def zwave(b: Column, _) -> Column:
    f, g = uint(b, 5), uint(b, 6)
    size = uint(b, 7)
    return struct(home_id=uint(b, 0, 4), src=uint(b, 4), dst=uint(b, 8), routed=bit(f, 7), ackreq=bit(f, 6), lowpower=bit(f, 5), speedmodified=bit(f, 4), headertype=bits(f, 0, 4), beam_control=bits(g, 5, 2), seqn=bits(g, 0, 4), length=size, cmd_class=F.when(bits(f, 0, 4) != 3, uint(b, 9)), cmd=F.when(bits(f, 0, 4) != 3, uint(b, 10)), crc=uint(b, F.length(b) - 1))


def dot11(b: Column, _) -> Column:
    fc = uint(b, 0)
    kind, sub = bits(fc, 2, 2), bits(fc, 4, 4)
    full = kind.isin(0, 2)
    four = (kind == 2) & (bits(uint(b, 1), 0, 2) == 3)
    return struct(type=kind, subtype=sub, proto=bits(fc, 0, 2), FCfield=uint(b, 1), ID=uint_le(b, 2, 2), addr1=mac(b, 4), addr2=F.when(full | sub.isin(8, 9, 10, 11, 14, 15), mac(b, 10)), addr3=F.when(full, mac(b, 16)), SC=F.when(full, uint_le(b, 22, 2)), addr4=F.when(four, mac(b, 24)))


def dot15d4(b: Column, _) -> Column:
    f = uint_le(b, 0, 2)
    dmode, smode, squeeze = bits(f, 10, 2), bits(f, 14, 2), bits(f, 6, 1)
    dsize = F.when(dmode == 2, 2).when(dmode == 3, 8).otherwise(0)
    after = F.when(dmode == 0, 3).otherwise(5 + dsize)
    sp = F.when((smode == 0) | ((squeeze == 1) & (dmode != 0)), 0).otherwise(2)
    at = after + sp
    wide = lambda off: uint64(F.concat(*(take(b, off + 7 - i, 1) for i in range(8))), 0)
    return struct(
        fcf_frametype=bits(f, 0, 3), fcf_security=bit(f, 3), fcf_pending=bit(f, 4), fcf_ackreq=bit(f, 5), fcf_panidcompress=bit(f, 6), fcf_destaddrmode=dmode, fcf_framever=bits(f, 12, 2), fcf_srcaddrmode=smode, seqnum=uint(b, 2), dest_panid=F.when(dmode >= 2, uint_le(b, 3, 2)), dest_addr_short=F.when(dmode == 2, uint_le(b, 5, 2)), dest_addr_long=F.when(dmode == 3, wide(F.lit(5))),
        src_panid=F.when((smode >= 2) & (sp == 2), uint_le(b, after, 2)), src_addr_short=F.when(smode == 2, uint_le(b, at, 2)), src_addr_long=F.when(smode == 3, wide(at)), fcs=uint_le(b, F.length(b) - 2, 2),
    )


def raw_layer(b: Column, _) -> Column:
    return F.struct(b.alias("load"))


#: column name: (layer kind, struct of the layer's bytes)
PROTOCOLS = {
    "coap": ("CoAP", coap), "cotp": ("COTP", cotp), "dhcp": ("DHCP", dhcp), "dnp3": ("DNP3", dnp3), "dns": ("DNS", dns), "dot11": ("Dot11", dot11), "dot15d4": ("Dot15d4", dot15d4), "ftp": ("FTP", ftp), "http": ("HTTP", http), "http2": ("HTTP2", http2), "iec104": ("IEC104", iec104),
    "imap": ("IMAP", imap), "l2tp": ("L2TP", l2tp), "modbus": ("Modbus", modbus), "mqtt": ("MQTT", mqtt), "mqttsn": ("MQTTSN", mqttsn), "pop3": ("POP3", pop3), "quic": ("QUIC", quic), "raw": ("Raw", raw_layer), "s7comm": ("S7Comm", s7comm), "smtp": ("SMTP", smtp), "ssh": ("SSH", ssh), "tftp": ("TFTP", tftp),
    "tls": ("TLS", tls), "tpkt": ("TPKT", tpkt), "zwave": ("ZWave", zwave),
}
