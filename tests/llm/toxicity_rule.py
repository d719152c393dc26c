"""4-fold choice of the entry rule within the training remainders (crc32 mod 5 in 1..4); then held out once."""
import sys,math,zlib; sys.path.insert(0,"/root/repo")
from collections import Counter, defaultdict
import pyarrow.dataset as ds, xxhash
from quillspark.llm import toxicity as T
def load(t):
    lab={}
    l=ds.dataset(f"/root/testdata/{t}/labels.parquet").to_table(columns=["doc_id","toxic"]).to_pylist()
    for r in l:
        if r["toxic"] in (0,1): lab[r["doc_id"]]=max(lab.get(r["doc_id"],0),r["toxic"])
    d=ds.dataset(f"/root/testdata/{t}/documents.parquet").to_table(columns=["doc_id","text"],filter=ds.field("doc_id").isin(list(lab)))
    return [(r["doc_id"],r["text"],lab[r["doc_id"]],zlib.crc32(str(r["doc_id"]).encode())%5) for r in d.to_pylist()]
def features(rows):
    out=[]
    for i,t,y,f in rows:
        words=["",*T.fold(t).split(),""]; ctx=defaultdict(set); terms=set()
        for k in range(1,len(words)-1):
            w=words[k]; own=(f" {w} ",*(f" {w[:n]}" for n in T.STEMS if len(w)>=n))
            a=xxhash.xxh64_intdigest(f"{words[k-1]} {words[k+1]}")
            for x in own: ctx[x].add(a)
        out.append((y,f,dict(ctx),t))
    return out
def spread(out,fs,purity):
    """Entries without the stems that are less pure in words that are no entries."""
    c=(Counter(),Counter())
    for y,_,ctx,_ in fs:
        rest=[t[1:-1] for t in ctx if t.endswith(" ") and t not in out]
        c[y].update({s for w in rest for n in T.STEMS if len(w)>=n and (s:=f" {w[:n]}") in out})
    return {t:w for t,w in out.items() if c[1][t]>=purity*c[0][t]}
def learn(fs,least,purity,chance,usectx,pure=True):
    c=(Counter(),Counter()); n=[0,0]
    for y,_,ctx,_ in fs:
        n[y]+=1; c[y].update(ctx.keys())
    tried=[t for t,k in c[1].items() if k>=3]; cand={}
    for t in tried:
        a,b=c[1][t],c[0][t]
        if a<purity*b: continue
        w=math.log((a+.5)/(n[1]+1))-math.log((b+.5)/(n[0]+1)); lo=w-2*math.sqrt(1/(a+.5)+1/(b+.5))
        if lo>least: cand[t]=(w,a,b)
    cx=(defaultdict(set),defaultdict(set))
    if usectx:
        for y,_,ctx,_ in fs:
            for t in ctx.keys()&cand.keys(): cx[y][t]|=ctx[t]
    share=n[1]/sum(n); lim=math.log(max(1,len(tried))/chance); out={}
    for t,(w,a,b) in cand.items():
        if not usectx or T.evidence(min(a,len(cx[1][t])),min(b,len(cx[0][t])),share)>lim: out[t]=round(w,6)
    return spread(out,fs,purity) if pure else out
def score(lex,fs):
    m=T.Matcher(lex); tp=fn=fp=tn=0
    for y,_,_,t in fs:
        p=m.score(t)>=.5
        if y: tp+=p; fn+=not p
        else: fp+=p; tn+=not p
    return tp,tp+fn,fp,fp+tn
tabs=sys.argv[1:]
F={t:features(load(t)) for t in tabs}
best=[]
for least in (.8,1.2,1.6):
  for purity in (2,4,8):
    for chance,ctx in ((.5,True),(.05,True),(5,True),(.5,False)):
      res=[]
      for t in tabs:
        tot=[0]*4
        for f in (1,2,3,4):
            tr=[x for x in F[t] if x[1] not in (0,f)]; va=[x for x in F[t] if x[1]==f]
            tot=[a+b for a,b in zip(tot,score(learn(tr,least,purity,chance,ctx),va))]
        res.append(tot)
      bal=sum(.5*(r[0]/max(1,r[1])+1-r[2]/max(1,r[3])) for r in res)/len(res)
      best.append((bal,least,purity,chance,ctx,res))
best.sort(reverse=True,key=lambda b:b[0])
for b in best[:8]: print(b)
print([b for b in best if b[1:5]==(1.2,4,.5,True)])
for cfg in (best[0][1:5],(1.2,4,.5,True)):
    print("held out",cfg,[score(learn([x for x in F[t] if x[1]],*cfg),[x for x in F[t] if x[1]==0]) for t in tabs])
